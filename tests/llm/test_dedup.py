"""The deduplicating operators against brute force on small, awkward tables."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from panelforge.llm import repeats, simhash_dedup, substring_dedup, suffix_dedup
from panelforge.llm.common import table  # noqa: F401

SCHEMA = "doc_id long, text string, source string, id string"


def documents() -> list[tuple]:
    pick = random.Random(4)
    words = ["la", "of", "the", "ñandú", "Éa", "x" * 30, "r2", "a b"]
    base = [" ".join(pick.choice(words) for _ in range(pick.randrange(5, 120))) for _ in range(12)]
    texts = [*base, None, "", "  \n\t ", "word", "of " * 400, "of " * 300, "ab" * 900, "ab" * 500 + "z", base[0], base[0], base[1] + " tail " + base[2], base[2][7:] + "\n" + base[1], "é" * 80, "xé" + "é" * 70]
    rows = [(i, t, "s", "clash") for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, base[3], None, None), (3, base[4], "again", None)]


def windows_removed(units: list[list], ids: list, length: int) -> list[list[bool]]:
    least = {}
    rank = [float("inf") if i is None else i for i in ids]
    for u, r in zip(units, rank, strict=True):
        for k in range(len(u) - length + 1):
            key = tuple(u[k : k + length])
            least[key] = min(least.get(key, r), r)
    out = []
    for u, r in zip(units, rank, strict=True):
        gone = [False] * len(u)
        for k in range(len(u) - length + 1):
            if least[tuple(u[k : k + length])] < r:
                gone[k : k + length] = [True] * length
        out.append(gone)
    return out


def test_word_windows(spark):
    rows = documents()
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    want = sorted((str(r[0]), len(w), sum(g), " ".join(x for x, y in zip(w, g, strict=True) if not y)) for r, w, g in zip(rows, words, windows_removed(words, [r[0] for r in rows], 13), strict=True))
    out = substring_dedup.remove_repeated_passages(spark.createDataFrame(rows, SCHEMA), carry=["id", "source"]).collect()
    assert sorted((str(r["id"]), r["n_words"], r["n_removed"], r["kept"]) for r in out) == want
    assert {r["carried"]["source"] for r in out} == {"s", "again", None}


@pytest.mark.parametrize("hot", [2, suffix_dedup.HOT_USES])
def test_byte_windows(spark, hot):
    rows = documents()
    data = [list((t or "").encode()) for _, t, *_ in rows]
    want = sorted((str(r[0]), len(d), sum(g), bytes(x for x, y in zip(d, g, strict=True) if not y)) for r, d, g in zip(rows, data, windows_removed(data, [r[0] for r in rows], 50), strict=True))
    out = suffix_dedup.remove_repeated_bytes(spark.createDataFrame(rows, SCHEMA), hot_uses=hot).collect()
    assert sorted((str(r["id"]), r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in out) == want
    assert all(sum(b - a for a, b in r["spans"]) == r["n_removed"] for r in out)


@pytest.mark.parametrize("hot", [2, substring_dedup.HOT_USES])
def test_word_windows_of_refined_keys(spark, hot):
    rows = documents()
    a, b = (sorted((str(r["id"]), r["kept"], str(r["spans"])) for r in substring_dedup.remove_repeated_passages(spark.createDataFrame(rows, SCHEMA), hot_uses=h).collect()) for h in (hot, 1 << 40))
    assert a == b


def in_process(texts: list[str], ids: list[int], runs_of, least_ids, shards: int, hot: int) -> list[list[tuple[int, int]]]:
    """The three passes without Spark: window starts [from, to) that go, of each text."""
    deal = [[i for i in range(len(texts)) if i % shards == s] for s in range(shards)]
    rows = [repeats.Rows(pa.table({"id": pa.array([ids[i] for i in d], pa.int64()), "text": pa.array([texts[i] for i in d], pa.string())})) for d in deal]
    runs = [runs_of(r) for r in rows]

    def regrouped(tables, column):
        groups = defaultdict(list)
        for t in tables:
            for row in repeats.received(t):
                groups[row[column]].append(row)
        return groups

    keys = regrouped([repeats.send_keys(s, u.key, u.row, r.ids, shards) for s, (r, u) in enumerate(zip(rows, runs, strict=True))], 1)
    flags = regrouped([repeats.share_keys(repeats.message(g), hot) for g in keys.values()], 2)
    shared = [repeats.Shared(r, u, flags[s], shards) for s, (r, u) in enumerate(zip(rows, runs, strict=True)) if flags[s]]
    sent = regrouped([repeats.message(x.send(s)) for s, x in enumerate(shared)], 1)
    back = regrouped([repeats.settle_texts(repeats.message(g), least_ids) for g in sent.values()], 2)
    out = [[] for _ in texts]
    for s, (r, u, x) in enumerate(zip(rows, runs, shared, strict=True)):
        first = u.first if hasattr(u, "first") else u.words.first
        for a, b in zip(*x.repeated(back.get(s, [])), strict=True):
            row = int(np.searchsorted(first, a, "right")) - 1
            out[deal[s][r.order[row]]] += [(int(k - first[row])) for k in range(a, b)]
    return [sorted(set(o)) for o in out]


@pytest.mark.parametrize("hot", [2, 1 << 40])
@pytest.mark.parametrize("clash", [False, True])
def test_clashing_hashes_change_nothing(monkeypatch, clash, hot):
    """With names of two bits nearly all keys are equal; texts decide what is."""
    pick = random.Random(9)
    words = ["la", "of", "the", "ñandú", "zz"]
    base = [" ".join(pick.choice(words) for _ in range(60)) for _ in range(8)]
    texts = [*base, base[0] + " x " + base[3], base[2][11:], base[1], "of " * 70, "of " * 50]
    ids = pick.sample(range(100), len(texts))
    if clash:
        monkeypatch.setattr(substring_dedup, "xxh64_intdigest", lambda w: len(w) & 1)
        monkeypatch.setattr(repeats, "xxh64_intdigest", lambda w: len(w) & 1)
        monkeypatch.setattr(suffix_dedup, "mix", lambda x: x & np.uint64(3))
        monkeypatch.setattr(substring_dedup, "mix", lambda x: x & np.uint64(3))
    for units, length, runs_of, least in (
        ([t.split() for t in texts], 13, lambda r: substring_dedup.WordRuns(r, 13), lambda t, i, k: substring_dedup.least_ids(t, i, k, 13)),
        ([list(t.encode()) for t in texts], 50, lambda r: suffix_dedup.ByteRuns(r, 50), lambda t, i, k: suffix_dedup.least_ids(t, i, k, 50)),
    ):
        smallest = defaultdict(lambda: 1000)
        for u, i in zip(units, ids, strict=True):
            for k in range(len(u) - length + 1):
                smallest[tuple(u[k : k + length])] = min(smallest[tuple(u[k : k + length])], i)
        want = [[k for k in range(len(u) - length + 1) if smallest[tuple(u[k : k + length])] < i] for u, i in zip(units, ids, strict=True)]
        assert in_process(texts, ids, runs_of, least, 3, hot) == want


def test_a_long_text(spark):
    """300,000 words of one document, half of it another's."""
    pick = random.Random(6)
    half = " ".join(f"w{pick.randrange(10**6)}" for _ in range(150_000))
    rows = [(1, half), (2, " ".join(f"v{pick.randrange(10**6)}" for _ in range(150_000)) + " " + half)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by_id = {r["id"]: r for r in substring_dedup.remove_repeated_passages(docs).collect()}
    assert by_id[1]["n_removed"] == 0 and by_id[2]["spans"] == [[150_000, 300_000]]
    by_id = {r["id"]: r for r in suffix_dedup.remove_repeated_bytes(docs, decode=True).collect()}
    assert by_id[1]["n_removed"] == 0 and by_id[2]["n_removed"] >= len(half) and by_id[2]["kept"] + half in (rows[1][1], rows[1][1][: -len(half) - 1] + half)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.remove_repeated_passages(none).count() == 0
    assert suffix_dedup.remove_repeated_bytes(none).count() == 0
    assert simhash_dedup.near_duplicates(none).count() == 0
    assert simhash_dedup.one_of_each(none).count() == 0


def test_suffix_array_and_prefixes():
    text = np.frombuffer(b"banana$bandana$ananas" * 5, np.uint8)
    sa, _ = suffix_dedup.suffix_array(text, 200)
    raw = text.tobytes()
    assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    lcp = suffix_dedup.common_prefixes(text, sa, 50)
    for k in range(1, len(sa)):
        a, b = raw[sa[k - 1] :], raw[sa[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp[k] == min(n, 50)


@pytest.mark.parametrize("tail", [b"", b"\0\0\0", b"\0" * 90])
def test_texts_that_differ_after_byte_80(tail):
    """The order is full, so no common prefix is carried to an unrelated neighbour."""
    for seed in range(20):
        pick = random.Random(seed)
        shared = bytes(pick.choice(b"ab") for _ in range(80))
        texts = [shared + b"z" * 20, shared + b"a" * 20, *[bytes(pick.choice(b"ab") for _ in range(90)) for _ in range(30)], b"ab" * 56 + tail]
        raw = b"".join(texts)
        text = np.frombuffer(raw, np.uint8)
        sa, _ = suffix_dedup.suffix_array(text, 50)
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        lcp = suffix_dedup.common_prefixes(text, sa, 50).tolist()
        for k in range(1, len(sa)):
            a, b = raw[sa[k - 1] :][:50], raw[sa[k] :][:50]
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        end = np.cumsum([len(t) for t in texts])
        usable = np.arange(len(raw)) + 50 <= np.repeat(end, [len(t) for t in texts])
        at, of = suffix_dedup.window_classes(text, usable, 50)
        strings = {(c, raw[a : a + 50]) for a, c in zip(at.tolist(), of.tolist(), strict=True)}
        assert len(strings) == len({c for c, _ in strings}) == len({s for _, s in strings})


def test_merging_of_small_suffix_arrays_by_binary_search():
    pick = random.Random(1)
    texts = sorted({bytes(pick.choice(b"ab") for _ in range(70)) for _ in range(60)} | {b"q" * 60 + bytes([i]) * 20 for i in range(1, 30)})
    ids, keys = np.arange(len(texts))[::-1].copy(), np.zeros(len(texts), np.int64)
    whole = suffix_dedup.least_ids(texts, ids, keys, 50)
    parts = suffix_dedup.least_ids(texts, ids, keys, 50, shard_text=200)
    least = defaultdict(lambda: 10**9)
    for t, i in zip(texts, ids.tolist(), strict=True):
        for k in range(len(t) - 49):
            least[t[k : k + 50]] = min(least[t[k : k + 50]], i)
    want = [[least[t[k : k + 50]] for k in range(len(t) - 49)] for t in texts]
    assert [x.tolist() for x in whole] == want and [x.tolist() for x in parts] == want


def test_interior_symbols_depend_on_their_range_only():
    """A passage between different neighbours has the same keys."""
    pick = random.Random(2)
    passage = [pick.choice(["a", "b", "c", "d", "e"]) for _ in range(40)]
    keys = set()
    for before, after in (("x y", "z"), ("c c", "a b"), ("", "")):
        class R:  # noqa: D106
            texts = [f"{before} {' '.join(passage)} {after}".encode()]
            ids = np.zeros(1, np.int64)

        words = substring_dedup.Words(R)
        starts, key = substring_dedup.window_keys(words, 13)
        first = len(before.split())
        keys.add(tuple(key[first : first + 28].tolist()))
    assert len(keys) == 1


def clusters(fps: list[int]) -> dict[int, int]:
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {f: find(f) for f in fps}


@pytest.mark.parametrize(("near", "wide", "hot"), [(1, 1, 2000), (1, 6, 20), (8, 1024, 1)])
def test_components_of_crowded_fingerprints(spark, monkeypatch, near, wide, hot):
    monkeypatch.setattr(simhash_dedup, "HOT", hot)  # all nodes are hot, some, none
    pick = random.Random(near)
    fps = {pick.getrandbits(63) for _ in range(60)}
    for _ in range(4):
        centre = pick.getrandbits(63)
        for _ in range(60):
            x = centre
            for _ in range(pick.randrange(6)):
                x ^= 1 << pick.randrange(63)
            fps.add(x)
    fps = sorted(fps)
    found = {r["node"]: r["root"] for r in simhash_dedup.connected(spark.createDataFrame([(f,) for f in fps], "fp long"), near, wide).collect()}
    assert {f: found.get(f, f) for f in fps} == clusters(fps)


@pytest.mark.parametrize("hot", [1, 6, 2000])
def test_near_duplicates(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash_dedup, "HOT", hot)
    rows = documents()
    out = simhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    fp = {r["id"]: r["fp"] for r in out if r["id"] not in (None, 3)}
    assert fp[12] == fp[13] == fp[14] == 0
    comp = {r["id"]: r["component"] for r in out}
    assert comp[20] == comp[21] == comp[0] == 0 and comp[13] == 12
    kept = simhash_dedup.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len({r["component"] for r in out}) <= len(kept) < len(rows) and list(kept[0].asDict()) == ["doc_id", "text", "source", "id"]


def test_prefixes_by_words_and_no_names_without_a_merge(monkeypatch):
    """Eight bytes at a time as one by one, zero bytes at the end too; names of windows are made only where suffix arrays are merged."""
    draw = np.random.default_rng(3)
    for n, letters in ((1, 1), (7, 1), (150, 1), (400, 2), (900, 3)):
        text = np.concatenate([draw.integers(0, letters, n), np.zeros(9)]).astype(np.uint8)
        sa, _ = suffix_dedup.suffix_array(text)
        raw = text.tobytes()
        shared = lambda i, j: next((k for k in range(50) if raw[i + k : i + k + 1] != raw[j + k : j + k + 1] or i + k >= len(raw)), 50)
        assert suffix_dedup.common_prefixes(text, sa, 50).tolist() == [0, *[shared(i, j) for i, j in zip(sa, sa[1:])]]
    texts, ids, keys = [b"a" * 60, b"a" * 55 + b"b" * 50], np.array([4, 2]), np.zeros(2, np.uint64)
    merged = suffix_dedup.least_ids(texts, ids, keys, 50, shard_text=60)
    monkeypatch.setattr(suffix_dedup, "_strings", None)
    assert [o.tolist() for o in suffix_dedup.least_ids(texts, ids, keys, 50)] == [o.tolist() for o in merged]
