"""Main text of a page by minimum-cut labelling of its blocks.

A page becomes a row of text blocks. A trained classifier's log-odds become the capacities between
a block and the terminals (content, boilerplate); neighbours in page order and blocks of the same
container are joined by smoothness edges. The cut of least capacity labels all blocks. Blocks whose
own capacity outweighs all their edges keep their label in some least cut and are folded into
their neighbours first; max-flow separates the rest.
"""

from __future__ import annotations

import html
import re
from collections import deque
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import table

_TOKEN = re.compile(
    r"<!--"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
#: Raw-text elements, dropped with what they hold; all others are left to the cut.
_DROPPED = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in "script style textarea title".split()}
#: Elements inside a line that part words.
_PARTING = frozenset("br option optgroup text desc".split())
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements that end a block of text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
#: Elements and parts of class, id or role that mark boilerplate or content.
BOILER_TAGS = frozenset("nav footer header aside form menu dialog fieldset button head search".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar side widget widgets footer foot header masthead topbar "
    "cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended pagination pager toolbar copyright legal disclaimer form search complementary contentinfo".split()
)
#: Of these, words that mean something else as a part of a longer name (side-by-side, free-form).
ALONE = frozenset("side form search foot legal related".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus discussion replies reply responses respond reviews".split())
CONTENT_TAGS = frozenset("article main".split())
CONTENT_WORDS = frozenset("article content main post entry story body text blogpost".split())
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd td figcaption article".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
FEATURES = ("one", "boiler_tag", "boiler_word", "comment", "content", "words", "links", "sentence", "text_tag", "outside")
ADJACENT, SAME_CONTAINER = 0.5, 0.5


class Block:
    """What is judged by itself: a block's text, or the part of it inside a marked span or button.

    ``raw`` keeps white space at its ends; parts with one ``line`` make one block of the page.
    """

    __slots__ = ("raw", "text", "container", "marks", "link_words", "tag", "line")

    def __init__(self, raw: str, container: int, marks: int, link_words: int, tag: str, line: int):
        self.raw, self.text = raw, " ".join(raw.split())
        self.container, self.marks, self.link_words, self.tag, self.line = container, marks, link_words, tag, line


_BOILER_TAG, _BOILER_WORD, _COMMENT, _CONTENT = 1, 2, 4, 8


@cache
def _tag_marks(tag: str) -> int:
    return _BOILER_TAG * (tag in BOILER_TAGS) | _CONTENT * (tag in CONTENT_TAGS)


def _marks(tag: str, attributes: str) -> int:
    out = _tag_marks(tag)
    if "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            names = (m[1] or m[2] or m[3] or "").lower()
            words = set(_SPLIT.split(names)) - (ALONE - set(names.split()))
            out |= _BOILER_WORD * (not words.isdisjoint(BOILER_WORDS)) | _COMMENT * (not words.isdisjoint(COMMENT_WORDS)) | _CONTENT * (not words.isdisjoint(CONTENT_WORDS))
    return out


def blocks(page: str) -> list[Block]:
    """The page's blocks in page order: references decoded, empty ones left out.

    A comment or a raw-text element without an end is only its own tag.
    """
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # name, number, marks so far
    inline: list[tuple[str, int, int]] = []  # elements inside a block, their marks, and how deep the block lies
    parts: list[str] = []
    linked, in_link, number, at, line = 0, 0, 0, 0, 0
    tag = ""

    def part() -> None:
        """End what is judged by itself; the block goes on."""
        nonlocal linked
        if parts:
            raw = html.unescape("".join(parts))
            if raw.strip():
                top = stack[-1]
                # what holds a paragraph counts as its container, not the paragraph
                container = stack[-2][1] if len(stack) > 1 and top[0] in _TEXT_TAGS and top[0] != "article" else top[1]
                out.append(Block(raw, container, top[2] | (inline[-1][1] if inline else 0), linked, top[0], line))
            elif out and out[-1].line == line:
                out[-1].raw += " "
            parts.clear()
        linked = 0

    def close() -> None:
        nonlocal line
        part()
        line += 1

    def leave() -> None:
        """What was opened inside a block ends with it, whether it was closed or not."""
        while inline and inline[-1][2] > len(stack):
            inline.pop()

    endless: set[str] = set()  # raw-text elements without an end tag from here on
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if in_link:
                linked += len(piece.split())
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at - 2) if "!" not in endless else -1  # <!--> is empty
            if end >= 0:
                at = max(at, end + 3)
            else:
                endless.add("!")
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ending = m[1] or m[4]
        if tag in _DROPPED:
            # an unclosed one ends at its own tag, as a self-closed one does
            if not ending and tag not in endless and not (m[3] or m[6] or "").endswith("/"):
                if end := _DROPPED[tag].search(page, at):
                    at = end.end()
                else:
                    endless.add(tag)
        elif tag in _PARTING:
            parts.append(" ")
        elif tag == "a":
            in_link = 0 if ending else 1
        elif tag in BLOCK_TAGS:
            close()
            if ending:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        leave()
                        break
            elif tag not in _VOID:
                if tag in ("p", "li", "dd", "dt", "td", "th", "tr") and stack[-1][0] in (tag, "p"):
                    stack.pop()
                if tag != "p" and stack[-1][0] == "p":
                    stack.pop()
                leave()
                number += 1
                stack.append((tag, number, stack[-1][2] | _marks(tag, m[3] or m[6] or "")))
                in_link = 0
        elif tag in BOILER_TAGS or tag == "span":
            # buttons and spans marked as boilerplate belong to a block but not to its text's kind
            if ending:
                if inline and inline[-1][0] == tag:
                    part()
                    inline.pop()
            elif tag == "span":
                marks = _marks(tag, m[3] or m[6] or "") & ~_CONTENT
                if marks:
                    part()
                if marks or inline:  # others only count inside one, for their ends
                    inline.append((tag, marks | (inline[-1][1] if inline else 0), len(stack)))
            else:
                part()
                inline.append((tag, _marks(tag, m[3] or m[6] or "") | (inline[-1][1] if inline else 0), len(stack)))
    if at < len(page):
        parts.append(page[at:])
    close()
    return out


def features(found: list[Block]) -> np.ndarray:
    x = np.zeros((len(found), len(FEATURES)))
    anywhere = any(b.marks & _CONTENT for b in found)
    for i, b in enumerate(found):
        words = b.text.count(" ") + 1
        content = bool(b.marks & _CONTENT)
        x[i] = (
            1, bool(b.marks & _BOILER_TAG), bool(b.marks & _BOILER_WORD), bool(b.marks & _COMMENT), content, min(words, 60) / 30,
            min(1.0, b.link_words / words), b.text[-1] in ".!?…:;»\"”)", b.tag in _TEXT_TAGS, anywhere and not content,
        )
    return x


def made_pages(n: int = 240, seed: int = 3) -> list[tuple[str, set[str]]]:
    """Made-up pages and their content blocks, to train the classifier on."""
    pick = np.random.default_rng(seed)
    syllables = ("ta", "ri", "mo", "sel", "ka", "du", "ven", "lo", "mi", "ner", "pa", "to")
    count = 0

    def words(least: int, most: int) -> str:
        nonlocal count
        count += 1
        return " ".join("".join(pick.choice(syllables, pick.integers(1, 4))) for _ in range(pick.integers(least, most))) + f" w{count}"

    def one(*x: str) -> str:
        return str(pick.choice(x))

    out = []
    for i in range(n):
        kept: list[str] = []

        def para(least: int = 5, most: int = 60, kept=kept) -> str:
            text = words(least, most).capitalize() + one(".", ".", ".", "!", "?", "")
            kept.append(text)
            return text

        def links(k: int) -> str:
            return "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(k))

        def linked() -> str:
            """A sentence of which much or most is linked: such things are in articles too."""
            parts = [words(1, 4) for _ in range(pick.integers(2, 6))]
            texts = [words(1, 3).capitalize(), *parts, words(1, 2) + "."]
            kept.append(" ".join(texts))
            return " ".join([texts[0], *(f'<a href="/y">{x}</a>' for x in parts), texts[-1]])

        kind = i % 4  # how the article is marked, the last: not at all
        start, end = (("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ("<div>", "</div>"))[kind]
        heading = para(2, 9)
        body = f"<h1>{heading}</h1>" + "".join(f"<{t}>{para()}</{t.split()[0]}>" for t in (one("p", "p", "p", "h2", "blockquote", "li") for _ in range(pick.integers(2, 12))))
        if kind < 3 and i % 3 == 0:  # only inside what is marked as the article can a block of links be told from a menu
            body += f"<p>{linked()}</p>" + f"<ul><li>{linked()}</li><li>{linked()}</li></ul>" * (i % 2)
        inside = one("", f'<div class="{one("ad", "promo", "share", "related")}">{words(3, 12)}.</div>', f'<aside>{words(4, 30)}.</aside>', f"<form><p>{words(3, 9)}</p></form>")
        top = one(f"<nav><ul>{links(6)}</ul></nav>", f'<div class="{one("menu", "navbar", "breadcrumb")}"><ul>{links(5)}</ul></div>', f"<ul>{links(7)}</ul>") + one("", f"<header><p>{words(2, 9)}</p></header>", f'<div id="{one("header", "cookie-notice", "banner")}">{words(4, 20)}.</div>')
        bottom = one(f"<footer>{words(3, 14)}.</footer>", f'<div class="footer"><p>{words(3, 9)}</p></div>', "") + one("", f'<div class="sidebar"><p>{words(8, 40)}.</p></div>')
        comments = one("", "", f'<section class="{one("comments", "comment-list")}"><p>{words(4, 30)}.</p><p>{words(4, 30)}!</p></section>', f'<div id="comments"><ul><li>{words(5, 25)}.</li></ul></div>')
        cut = one("a", "b")
        page = f"<html><head><title>t</title></head><body>{top}{start}{body}{inside}{comments if cut == 'a' else ''}{end}{comments if cut == 'b' else ''}{bottom}</body></html>"
        out.append((page, set(kept)))
    return out


def fit_blocks(pages: list[tuple[str, set[str]]] | None = None, l2: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic classifier of blocks (content: 1), by Newton's method."""
    made = [(features(b), [x.text in kept for x in b]) for page, kept in (pages or made_pages()) for b in [blocks(page)]]
    x, y = np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made]).astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)), x.T @ (p - y) + l2 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def max_flow_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of a least cut: node i loses |gain| if labelled against its sign, an edge its weight if cut."""
    n = len(gain)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, forth: float, back: float) -> None:
        at[a].append(len(to))
        to.append(b)
        room.append(forth)
        at[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, g in enumerate(gain):
        if g > 0:
            edge(source, i, g, 0.0)
        elif g < 0:
            edge(i, sink, -g, 0.0)
    for a, b, w in edges:
        edge(a, b, w, w)
    while True:  # Edmonds and Karp: shortest augmenting paths
        via = [-1] * (n + 2)
        queue = deque([source])
        via[source] = -2
        while queue and via[sink] == -1:
            u = queue.popleft()
            for e in at[u]:
                if room[e] > 1e-12 and via[to[e]] == -1:
                    via[to[e]] = e
                    queue.append(to[e])
        if via[sink] == -1:
            return [via[i] != -1 for i in range(n)]
        push, v = float("inf"), sink
        while v != source:
            push = min(push, room[via[v]])
            v = to[via[v] ^ 1]
        v = sink
        while v != source:
            room[via[v]] -= push
            room[via[v] ^ 1] += push
            v = to[via[v] ^ 1]


def label(gain: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """The least cut; blocks that outweigh their edges are settled before max-flow."""
    n = len(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    gain, out = list(gain), [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if out[i] is None and abs(gain[i]) >= sum(near[i].values()) and gain[i] != 0:
            out[i] = gain[i] > 0
            for j, w in near[i].items():
                gain[j] += w if out[i] else -w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if out[i] is None]
    if rest:
        index = {b: k for k, b in enumerate(rest)}
        cut = max_flow_cut([gain[i] for i in rest], [(index[i], index[j], w) for i in rest for j, w in near[i].items() if i < j])
        for i, side in zip(rest, cut, strict=True):
            out[i] = side
    return out


def main_text(page: str | None, weights: np.ndarray) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    gain = (features(found) @ weights).tolist()
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            edges[i - 1, i] = ADJACENT if found[i - 1].marks == b.marks else ADJACENT / 4
        if (j := last.get(b.container)) is not None:
            edges[j, i] = edges.get((j, i), 0.0) + SAME_CONTAINER
        last[b.container] = i
    keep = label(gain, edges)
    lines: dict[int, list[str]] = {}
    for b, k in zip(found, keep, strict=True):
        if k:
            lines.setdefault(b.line, []).append(b.raw)
    return "\n".join(" ".join("".join(raw).split()) for raw in lines.values())


def extract(pages: DataFrame, weights: np.ndarray, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id``, ``url`` and ``text`` of every row; null and empty pages have an empty text.

    Pages of any length are read whole, repeated rows have equal texts, an empty table gives an
    empty result. Other columns are ignored.
    """

    def run(batches):
        for b in batches:
            text = [main_text(x, weights) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(text, pa.string())], ["id", "url", "text"])

    own = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    return own.mapInArrow(run, "id long, url string, text string")


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"), fit_blocks())
    return out.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
