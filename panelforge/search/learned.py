"""A learned generator of formulas, batch by batch, and the search that it drives.

Weights are a table of a number for each place and token; no weights mean that all formulas up to
the longest are equally likely, since a token's chance is in proportion to the formulas that can
follow it. A batch is an array of token indices. Its formulas are compared by the ranks of their
rewards, and one step moves all weights along the gradient of the batch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from panelforge.functions.formula import MAX_TOKENS, Formula
from panelforge.functions.formula_space import ARITY, TOKENS, completions

#: log of how many ways there are to close so many places with at most so many tokens.
with np.errstate(divide="ignore"):
    _OPEN = np.log(np.cumsum(completions(), axis=1))


def no_weights() -> np.ndarray:
    return np.zeros((MAX_TOKENS, len(TOKENS)))


def _scores(weights: np.ndarray, at: int, places: np.ndarray) -> np.ndarray:
    """[formula, token] of log chances up to a constant, for formulas with ``places`` open at ``at``."""
    return weights[at] + _OPEN[np.clip(places[:, None] - 1 + ARITY, 0, MAX_TOKENS), MAX_TOKENS - at - 1]


def drawn(weights: np.ndarray, n: int, *seed: int) -> np.ndarray:
    """``n`` formulas as token indices, -1 behind their ends; the same for the same seed."""
    noise = np.random.default_rng(seed).gumbel(size=(n, MAX_TOKENS, len(TOKENS)))  # the largest score plus noise is a draw by chance
    out, places = np.full((n, MAX_TOKENS), -1), np.ones(n, np.int64)
    for at in range(MAX_TOKENS):
        live = np.flatnonzero(places)
        out[live, at] = (_scores(weights, at, places[live]) + noise[live, at]).argmax(axis=1)
        places[live] += ARITY[out[live, at]] - 1
    return out


def as_formula(row: np.ndarray) -> Formula:
    return Formula(tuple(TOKENS[t] for t in row if t >= 0))


def as_indices(f: Formula) -> np.ndarray:
    out = np.full(MAX_TOKENS, -1)
    out[: len(f.tokens)] = [TOKENS.index(t) for t in f.tokens]
    return out


def log_chances(weights: np.ndarray, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[formula, place, token] of log chances along the formulas of ``batch``, and which places they use."""
    used = batch >= 0
    moves = np.where(used, ARITY[batch] - 1, 0)
    places = 1 + np.cumsum(moves, axis=1) - moves
    scores = np.stack([_scores(weights, at, places[:, at]) for at in range(MAX_TOKENS)], axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return scores - np.log(np.exp(scores).sum(axis=2, keepdims=True)), used


def gradient(weights: np.ndarray, batch: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """Of the sum of worth times log chance over the batch, by the weights."""
    log, used = log_chances(weights, batch)
    share = np.where(used[:, :, None], np.exp(log), 0.0)
    hit = np.zeros_like(share)
    np.put_along_axis(hit, np.maximum(batch, 0)[:, :, None], used[:, :, None].astype(float), axis=2)
    return np.einsum("f,fpt->pt", worth, hit - share)


def improved(weights: np.ndarray, batch: np.ndarray, rewards: np.ndarray, rate: float) -> np.ndarray:
    """Weights after a step for a batch; a formula is worth its reward's centred rank, so scale and outliers don't matter."""
    if not len(batch):
        return weights
    below, equal = (rewards[:, None] > rewards).sum(axis=1), (rewards[:, None] == rewards).sum(axis=1)
    worth = (below + equal / 2) / len(rewards) - 0.5
    return weights + rate * gradient(weights, batch, worth)


@dataclass
class Budget:
    """When a search stops: the first limit that is reached."""

    completed: int
    unique: int
    attempts: int


@dataclass
class Search:
    """What a search has met and learned so far; its dictionary form is its checkpoint."""

    seed: int = 0
    rate: float = 0.5
    attempts: int = 0
    rewards: dict[str, float] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)
    weights: list[list[float]] = field(default_factory=lambda: no_weights().tolist())

    def done(self, budget: Budget) -> bool:
        return self.attempts >= budget.attempts or len(self.order) >= budget.unique or len(self.rewards) >= budget.completed


def search(evaluate, budget: Budget, found: Search, batch: int = 8, after=None) -> Search:
    """Draw batches, evaluate new formulas together, learn from all rewards, until the budget is spent.

    ``evaluate`` takes formulas and returns for each a reward or the text of a failure, so a batch is
    one distributed plan. Repeated formulas count as attempts only. A rate of 0 draws without
    learning. ``after`` is called with the search after every batch, to keep a checkpoint: draws
    follow from the seed and the attempts so far, so a search that goes on from one makes the same.
    """
    while not found.done(budget):
        rows = drawn(np.array(found.weights), min(batch, budget.attempts - found.attempts), found.seed, found.attempts)
        met = [as_formula(r).canonical() for r in rows]
        found.attempts += len(rows)
        known = found.rewards.keys() | found.failed.keys()
        new = {f.text(): f for f in met if not f.trivial() and f.text() not in known}
        new = dict(list(new.items())[: min(budget.unique - len(found.order), budget.completed - len(found.rewards))])
        for text, got in zip(new, evaluate(list(new.values())) if new else [], strict=True):
            found.order.append(text)
            if isinstance(got, str):
                found.failed[text] = got
            else:
                found.rewards[text] = float(got)
        judged = [i for i, f in enumerate(met) if f.text() in found.rewards]
        found.weights = improved(np.array(found.weights), rows[judged], np.array([found.rewards[met[i].text()] for i in judged]), found.rate).tolist()
        if after:
            after(found)
    return found
