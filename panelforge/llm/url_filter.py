"""URL filtering: host and path rules first, gradient-boosted trees over lexical features for the rest."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import boosting
from .common import table

#: The contract's rules, as (verdict, host and path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Labelled URLs that the trees are fitted on, at most.
MAX_ROWS = 20_000
#: Words by which a host names what it is blocked for: the labels where a caller has none.
TELLING = ("adult", "ads", "bet", "bets", "betting", "casino", "dating", "escort", "gambling", "jackpot", "lottery", "pharma", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "viagra", "warez", "xxx")
NAMES = ("length", "host_length", "depth", "labels", "digits", "host_digits", "hyphens", "entropy", "host_entropy", "parameters", "longest_label", "is_address", "escapes", "suffix")
_URL = re.compile(r"://([^/?#]*)([^?#]*)(?:\?([^#]*))?", re.S)


def _parts(url: str | None) -> tuple[str, str, str]:
    m = _URL.search(url or "")
    return (m[1].lower(), m[2], m[3] or "") if m else ("", "", "")


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * np.log2(c / n) for c in Counter(s).values()) if n else 0.0


def _suffix(host: str) -> str:
    return host.rpartition(".")[2]


@dataclass
class UrlModel:
    """How suffixes are labelled, and the trees."""

    suffixes: dict[str, float]
    trees: boosting.Trees

    def features(self, urls: list[str | None]) -> np.ndarray:
        return np.array([_features(u, self.suffixes) for u in urls], np.float64).reshape(-1, len(NAMES))


def _features(url: str | None, suffixes: dict[str, float]) -> list[float]:
    url = url or ""
    host, path, query = _parts(url)
    labels = host.split(".")
    return [
        len(url), len(host), len([x for x in path.split("/") if x]), len(labels), sum(map(str.isdigit, url)) / max(1, len(url)),
        sum(map(str.isdigit, host)) / max(1, len(host)), host.count("-"), _entropy(url), _entropy(host), query.count("&") + 1 if query else 0,
        max(map(len, labels)), float(bool(re.fullmatch(r"[\d.:\[\]]+", host))), url.count("%"), suffixes.get(_suffix(host), 0.0),
    ]


def _log_odds(bad: Counter, good: Counter, n_bad: int, n_good: int, smooth: float) -> dict[str, float]:
    return {k: float(np.log((bad[k] + smooth) / (n_bad + 2 * smooth)) - np.log((good[k] + smooth) / (n_good + 2 * smooth))) for k in sorted(bad.keys() | good.keys())}


def fit_urls(labelled: list[tuple[str, int]]) -> UrlModel:
    """Suffix statistics are taken from one half of the URLs (1: block), the trees are fitted on the other half.

    Without labels every URL scores 0.5; with one class only, that class.
    """
    half = [[(u, y) for u, y in labelled if zlib.crc32((u or "").encode()) & 1 == k] for k in (0, 1)]
    n = [max(1, sum(y == c for _, y in half[0])) for c in (0, 1)]
    by = (Counter(), Counter())
    for url, y in half[0]:
        by[y][_suffix(_parts(url)[0])] += 1
    model = UrlModel(_log_odds(by[1], by[0], n[1], n[0], 1.0), boosting.constant(0.5))
    x, y = model.features([u for u, _ in half[1]]), np.array([y for _, y in half[1]], float)
    model.trees = boosting.fit(x, y, trees=40, depth=4, least=0.1)  # what is blocked may be a handful
    return model


def telling_urls(pages: DataFrame, url_col: str = "url", words=TELLING, most: int = MAX_ROWS) -> list[tuple[str, int]]:
    """Weakly labelled URLs where nothing else labels any: 1 where the host has one of ``words`` as a word of its own.

    Distinct ones, ``most`` in an order by hash. All others count as fit to be allowed, so the trees
    learn what hosts with telling names have in common that can be counted: their hyphens, lengths,
    entropies and suffixes, never the words. The rules' verdicts aren't used: they say nothing about
    what they leave open.
    """
    own = pages.select(F.col(f"`{url_col}`").alias("url")).filter("url is not null").distinct()
    host, _ = host_and_path(F.col("url"))
    tells = F.arrays_overlap(F.split(host, "[^a-z]+"), F.array(*map(F.lit, words)))
    few = own.withColumn("tells", tells.cast("int")).orderBy(F.xxhash64("url"), "url").limit(most)
    return [(r["url"], r["tells"]) for r in few.collect()]  # ``most`` rows


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``; both empty if there is none or the url is null."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), upper, upper.lower()), F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, model: UrlModel, id_col: str = "page_id", url_col: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """Per row: ``id``, ``url``, ``host``, ``path``, ``rule``, ``score`` (of the trees, 1: block) and ``verdict``.

    The rule's verdict holds, else the trees'. Null urls and those without ``://`` have an empty
    host and path and get the trees' verdict on what there is; urls of any length are read whole.
    Repeated rows have repeated results, an empty table an empty one. Other columns are ignored.
    """

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.trees.score(model.features(b.column(1).to_pylist())))], [*b.schema.names, "score"])

    own = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"))
    scored = own.mapInArrow(run, "id long, url string, score double")
    host, path = host_and_path(F.col("url"))
    scored = scored.withColumns({"host": host, "path": path})
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("id", "url", "host", "path", rule.alias("rule"), "score", F.coalesce(verdict, judged).alias("verdict"))


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = filter_urls(pages, fit_urls(telling_urls(pages)))
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "score")
