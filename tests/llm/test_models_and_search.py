"""Decontamination, packing, classifiers, extraction and search on small, awkward tables."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from panelforge.llm import boosting, decontamination, html_extraction, packing, quality, toxicity, url_filter, vector_search


def test_contamination(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen Été"
    docs = [(1, "xx " + item.upper().replace("É", "É") + " yy"), (2, "ONE, two; three four-five six seven eight nine ten eleven twelve thirteen"), (3, None), (4, ""), (5, "Short  phrase!"), (6, "one two three four five six seven eight nine ten eleven twelve zz"), (1, "other row")]
    out = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("a", item), ("b", "short phrase"), ("c", None), ("d", " ")], "item_id string, text string")).collect()
    got = sorted((r["id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in out)
    assert got == [(1, 2, 0, [], False), (1, 17, 14, ["a"], True), (2, 13, 13, ["a"], True), (3, 0, 0, [], False), (4, 0, 0, [], False), (5, 2, 2, ["b"], True), (6, 13, 0, [], False)]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b x x x x a"), (2, "b a")], "doc_id long, text string")
    out = decontamination.proximity_matches(docs, spark.createDataFrame([("a", "b")], "a string, b string"), 3, "doc_id").collect()
    assert sorted((r["doc_id"], r["pos"], r["other"]) for r in out) == [(1, 0, 3), (2, 1, 0)]


def test_proximity_returns_all_places(spark):
    texts = {1: "a b b x x x b a", 2: "b a a b", None: "a b", 3: "b x x x x x a"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for within in (1, 3, 5):
        out = decontamination.proximity_matches(docs, spark.createDataFrame([("a", "b")], "a string, b string"), within, "doc_id").collect()
        words = {i: t.split() for i, t in texts.items()}
        want = [(str(i), p, q) for i, w in words.items() for p, x in enumerate(w) for q, y in enumerate(w) if (x, y) == ("a", "b") and abs(p - q) <= within]
        assert sorted((str(r["doc_id"]), r["pos"], r["other"]) for r in out) == sorted(want)


def test_packing(spark):
    texts = [None, "", "Hello  wörld's <|endoftext|>x", "a b c " * 1500, "tail " * 700, "\x1fodd space"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (None, "x")]
    path = public_tokenizers.path("word_bpe_49k.json")
    out = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    t = Tokenizer.from_file(path)
    want = []
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want += [(str(i), k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted((str(r["id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist() and sum(n for _, n in parts) <= 2048


def test_plan_uses_the_histogram_up():
    pick = np.random.default_rng(0)
    lengths = np.minimum(2048, pick.lognormal(5.5, 1, 5000).astype(int) + 1)
    made = packing.plan(dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)], strict=True)))
    used = np.zeros(2049, int)
    for parts, n in made:
        assert sum(parts) <= 2048 and n > 0
        np.add.at(used, list(parts), n)
    assert (used == np.bincount(lengths, minlength=2049)).all()
    assert sum(n for _, n in made) <= 1.01 * np.ceil(lengths.sum() / 2048)


def test_trees():
    pick = np.random.default_rng(1)
    x = pick.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    assert boosting.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_quality_and_toxicity(spark):
    pick = np.random.default_rng(2)
    words = ["river", "stone", "light", "over", "under", "runs", "the", "a"]
    rows, labels = [], []
    for i in range(300):
        bad, toxic = i % 3 == 0, i % 5 == 0
        text = " ".join(str(pick.choice(words)) + ("$$$" if bad else "") for _ in range(40)) + (" you idiot" if toxic else "") + (" muslim" if i % 10 == 0 else "")
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (1001, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    scored = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, quality.fit_quality(docs, lab)).collect()}
    assert len(scored) == 302 and np.mean([(scored[i] > 0.5) == bool(q) for i, q, _ in labels]) > 0.98
    model = toxicity.fit_toxicity(docs, lab)
    score = model.scorer()
    assert score("you idiot") > 0.7 > 0.3 > score("a muslim neighbour") and abs(score("a muslim neighbour") - score("a christian neighbour")) < 0.05
    assert toxicity.score_toxicity(docs, model).filter("score is null").count() == 0
    assert toxicity.fit_toxicity(docs, lab.limit(0)).scorer()("x") == 0.5


def made_urls(n: int, seed: int) -> list[tuple[str, int]]:
    """Blocked ones have digits and many parameters, or the suffix zz."""
    pick = random.Random(seed)
    word = lambda k: "".join(pick.choice("abcdefgh") for _ in range(k))
    out = []
    for i in range(n):
        good = f"https://{word(7)}.org/{word(4)}/{word(5)}"
        bad = f"https://{word(5)}{pick.randrange(10**6)}.org/{word(3)}?" + "&".join(f"{word(1)}={pick.randrange(10**6)}" for _ in range(4)) if i % 4 else f"https://{word(7)}.zz/{word(4)}"
        out.append((bad, 1) if i % 2 else (good, 0))
    return out


def test_urls(spark):
    model = url_filter.fit_urls(made_urls(900, 1))
    held = made_urls(300, 2)
    urls = ["http://WWW.Example.com/en/x?y#z", "https://example.com/en/1", "http://a.b.net/es/", "http://net/fr/q", "http://com", "no scheme", None, "", "https://abcdefg.org/" + "x/" * 50_000]
    rows = [(i, u, "verdict") for i, u in enumerate([*urls, urls[0], *[u for u, _ in held]])]
    out = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), model)
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") == got[9] and got[1][2:] == ("example.com/en/", "block")
    assert got[2][2:] == ("net/es/", "block") and got[3][2:] == ("net/fr/", "block") and got[4][:3] == ("com", "", None)
    assert got[5][:3] == got[6][:3] == got[7][:3] == ("", "", None) and len(got[8][1]) == 100_001
    right = sum((got[10 + i][3] == "block") == bool(y) for i, (_, y) in enumerate(held))
    assert right >= 0.97 * len(held)
    score = model.trees.score(model.features([u for u, _ in held]))
    assert score.tolist() == pytest.approx([walked(model.trees, x) for x in model.features([u for u, _ in held])])
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), model).count() == 0


def walked(trees, x) -> float:
    """One row down every tree, node by node."""
    total = trees.start
    for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
        node = 0
        while node < len(f):
            node = 2 * node + (2 if x[f[node]] > t[node] else 1)
        total += v[node - len(f)]
    return 1 / (1 + np.exp(-total))


def test_telling_hosts_label_urls(spark):
    urls = ["http://a.com/casino", "http://free-bets.b.net/de/1", "http://www.Poker.org/", "http://alphabets.org/", None, "http://a.com/casino", "no casino here"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    assert sorted(url_filter.telling_urls(pages)) == [("http://a.com/casino", 0), ("http://alphabets.org/", 0), ("http://free-bets.b.net/de/1", 1), ("http://www.Poker.org/", 1), ("no casino here", 0)]
    assert url_filter.fit_urls([]).trees.score(np.zeros((1, len(url_filter.NAMES)))).tolist() == [0.5]
    assert (url_filter.fit_urls([(f"http://a{i}.org/", 0) for i in range(50)]).trees.score(np.zeros((1, len(url_filter.NAMES)))) < 0.01).all()  # nothing to block: allowed


def test_urls_without_a_rule_get_both_verdicts(spark):
    """And hosts with a word that no label knows are blocked for what they have in common with the others."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    out = url_filter.filter_urls(pages, url_filter.fit_urls(url_filter.telling_urls(pages))).filter("rule is null")
    n = {r["verdict"]: r["count"] for r in out.groupBy("verdict").count().collect()}
    assert 0 < n["block"] < 0.05 * n["allow"]
    urls = url_filter.telling_urls(pages)
    for word in ("casino", "pills", "spam", "adult"):
        model = url_filter.fit_urls([(u, y) for u, y in urls if word not in u])
        held = [u for u, y in urls if word in u and y]
        assert held and (model.trees.score(model.features(held)) >= 0.5).mean() > 0.9


def test_splits_against_all_splits():
    pick = np.random.default_rng(8)
    for _ in range(60):
        n, m = int(pick.integers(8, 40)), int(pick.integers(1, 4))
        x, y = pick.integers(0, 5, (n, m)).astype(float), pick.integers(0, 2, n).astype(float)
        if y.min() == y.max():
            continue
        got = boosting.fit(x, y, trees=1, depth=1, rate=1.0, l2=1.0, least=0.5)
        p = y.mean()
        g, h = p - y, np.full(n, p * (1 - p))
        worth = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        best = 0.0
        for j in range(m):
            for t in np.unique(x[:, j]):
                left = x[:, j] <= t
                if min(h[left].sum(), h[~left].sum()) >= 0.5:
                    best = max(best, worth(left) + worth(~left) - worth(np.ones(n, bool)))
        right = x[:, got.feature[0, 0]] > got.threshold[0, 0]
        made = worth(right) + worth(~right) - worth(np.ones(n, bool)) if right.any() else 0.0
        assert made == pytest.approx(best, abs=1e-9)
        for side, value in ((~right, got.value[0, 0]), (right, got.value[0, 1])):
            if side.any():
                assert value == pytest.approx(-g[side].sum() / (h[side].sum() + 1.0))


def test_ids_equal_whole_text_encoding():
    path = public_tokenizers.path("word_bpe_49k.json")
    ids, pick = packing.Ids(path), random.Random(3)
    letters = "***abcñÉéüß×÷&-XYZ09 .,;:!?)\"'-_<|≯́éΣσẞﬁİ\n\t \x0b\xa0中😀&="
    texts = ["".join(pick.choice(letters) for _ in range(pick.randrange(40))) for _ in range(20_000)] + [None, "", " ", "a<|endoftext|>b,", "<|ENDOFTEXT|>.", "don't, it'll!", "A<|startoftext|>"]
    flat, ends = ids.documents(pa.array(texts), 0)
    whole = Tokenizer.from_file(path)
    first = 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        assert flat[first:end].tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        first = end


def brute_cut(gain, edges):
    return min(sum(abs(g) for i, g in enumerate(gain) if g and (s >> i & 1) != (g > 0)) + sum(w for (a, b), w in edges.items() if (s >> a ^ s >> b) & 1) for s in range(1 << len(gain)))


def test_least_cut():
    pick = np.random.default_rng(5)
    for _ in range(60):
        n = int(pick.integers(1, 8))
        gain = pick.normal(size=n).tolist()
        edges = {(i, j): float(pick.random()) for i in range(n) for j in range(i + 1, n) if pick.random() < 0.5}
        cut = html_extraction.label(gain, edges)
        cost = sum(abs(g) for g, c in zip(gain, cut, strict=True) if (g > 0) != c) + sum(w for (a, b), w in edges.items() if cut[a] != cut[b])
        assert cost == pytest.approx(brute_cut(gain, edges))


def test_extraction(spark):
    page = '<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="ad">Buy now.</div><article><h1>Head &amp; tail</h1><p>One\n  two<br>three.<p><b>Bold</b> text&nbsp;here.</p></article><div id="comments"><p>Nice post indeed.</p></div><footer>&copy; us</footer>'
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p>unclosed <b>'<i"), (5, "x", "<" * 500)]
    out = {r["id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), html_extraction.fit_blocks()).collect()}
    assert out[1] == "Head & tail\nOne two three.\nBold text here." and out[2] == out[3] == "" and not re.search("<b>", out[4])


@pytest.mark.parametrize("page, want", [
    ("<p>a</p><noscript><p>b</p></noscript><p>c</p>", ["a", "b", "c"]),
    ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p>", ["Let x=2 be."]),
    ("<p>a</p><svg width='1'/><p>b</p><math/><p>c</p>", ["a", "b", "c"]),
    ("<p>a</p><svg><path d='M0'><p>b</p><iframe src=x><p>c</p>", ["a", "b", "c"]),
    ("<video-player><p>a</p></video-player><title-bar>b</title-bar><object-x><p>c</p><script-x><p>d</p>", ["a", "b", "c", "d"]),
    ("<p>Pick <select><option>one<option>two</select></p><template><p>t</p></template>", ["Pick one two", "t"]),
    ("<p>a<object>b</object> <canvas>c</canvas> <audio>d</audio> <video>e</video></p>", ["ab c d e"]),
    ("<p>a</p><SCRIPT>var x='<p>no</p>'</Script ><style>p{}</style\n><p>b</p><textarea><p>no</textarea><title>no</title>", ["a", "b"]),
    ("<p>a</p><script src=x /><p>b</p><script><p>c</p><style><script><p>d</p>", ["a", "b", "c", "d"]),
    ("<p>a</p><script>var x = 1</script", ["a"]),
])
def test_only_raw_text_elements_are_dropped(page, want):
    assert [b.text for b in html_extraction.blocks(page)] == want


def test_search(spark):
    pick = np.random.default_rng(6)
    x = pick.normal(size=(400, 8))
    rows = [(i, [float(v) for v in np.float32(x[i % 390])]) for i in range(400)] + [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [1.0]), (504, [None] * 8)]
    out = vector_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), vector_search.F.col("id") % 50 == 0).collect()
    v = np.array([r[1] for r in rows[:400]])
    u = v / np.linalg.norm(v, axis=1)[:, None]
    hit = 0
    for q in range(0, 400, 50):
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(400), -np.round(s, 12)))[:5]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [g[0] for g in got] == [1, 2, 3, 4, 5] and all(abs(g[2] - s[g[1]]) < 1e-12 for g in got)
        hit += len({g[1] for g in got} & set(best.tolist()))
    assert hit >= 0.9 * 40 and {r["query_id"] for r in out} == set(range(0, 400, 50))
    assert vector_search.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), vector_search.F.lit(True)).count() == 0


def test_search_ties_and_scaled_copies(spark):
    """Multiples of one vector are different entries with one cosine: the smaller ids win."""
    base = np.array([1.0, -2.0, 0.5, 3.0])
    rows = [(i, (base * (i + 1)).tolist()) for i in range(40)] + [(i, (-base).tolist()) for i in range(100, 130)] + [(i, [0.1 * i, 1.0, 2.0, 3.0]) for i in range(200, 230)]
    rows += [rows[3]]
    out = vector_search.search(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string"), vector_search.F.col("id") % 10 == 0).collect()
    v = {i: np.array(x) for i, x in rows}
    cosine = lambda a, b: vector_search._cosine(a[None], b[None])[0]
    hits = total = 0
    for query in sorted({r["query_id"] for r in out}):
        want = sorted((-cosine(v[query], x), i) for i, x in v.items() if i != query)[:5]
        got = [(r["vec_id"], r["score"]) for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == query]
        assert len(got) == 5 and got == sorted(got, key=lambda g: (-g[1], g[0]))
        hits += len({g[0] for g in got} & {w[1] for w in want})
        total += 5
    assert hits >= 0.9 * total
    q, ids = np.array([base]), np.arange(40)
    row, col, _ = vector_search._best(q, np.array([base * (i + 1) for i in range(40)]), ids, 6)
    best = sorted((-cosine(base, base * (i + 1)), i) for i in range(40))[:6]
    assert col.tolist() == [i for _, i in best]


def test_groups_of_cells():
    sizes = np.array([3, 0, 4, 25, 1, 9, 9, 2])
    parts, base = vector_search.groups(sizes, 10)
    assert parts.tolist() == [1, 1, 1, 3, 1, 1, 1, 1]
    filled = {}
    for c, n in enumerate(sizes.tolist()):
        for p in range(parts[c]):
            filled.setdefault(int(base[c] + p), []).append(n / parts[c])
    assert all(sum(x) <= 10 for x in filled.values()) and len(filled[int(base[3])]) == 1


PAGES = [
    ("<article><p>Hello <span class='text'>brave</span> new world.</p></article>", "Hello brave new world."),
    ("<article><p>Let <math><mi>x</mi></math> be the number of all cases.</p></article>", "Let x be the number of all cases."),
    ("<article><p>One is here and it is long. <span class='ad'>Buy now</span>Two is here and it is long.</p></article>", "One is here and it is long. Two is here and it is long."),
    ("<article><p>First of the paragraphs.<br>On a new line of it.</p></article>", "First of the paragraphs. On a new line of it."),
    ("<article><p>Text &amp; more &lt;b&gt; &eacute;t&eacute; &#x41; of it.</p></article>", "Text & more <b> été A of it."),
    ("<nav><a href='/'>Home</a><a href='/x'>News</a></nav><article><p>The story of the day is told here.</p></article><footer>All rights reserved</footer>", "The story of the day is told here."),
    ("<article><h1>A heading</h1><p>The story of the day is told here.</p></article>", "A heading\nThe story of the day is told here."),
    ("<article><p>The story of the day is told here.</p><script>var a = '<p>no</p>';</script><style>p {}</style></article>", "The story of the day is told here."),
    ("<article><p>The story of the day is told here.</p></article><section class='comments'><p>Great post, I liked it a lot.</p></section>", "The story of the day is told here."),
    ("<article><p>The story of the day is told here.</p><form><p>Your name and address please</p></form></article>", "The story of the day is told here."),
    ("<main><p>The story of the day is told here.</p><aside>Related stories to read next</aside></main>", "The story of the day is told here."),
    ("<div class='cookie-notice'>We use cookies on this site.</div><main><p>The story of the day is told here.</p></main>", "The story of the day is told here."),
    ("<main><p>The <b>story</b> of the <i>day</i> is <a href='/x'>told</a> here.</p></main>", "The story of the day is told here."),
    ("<main><p>The story\n\n of   the\tday is told here.</p></main>", "The story of the day is told here."),
    ("<main><p>The story <!-- not <p> this --> of the day.</p></main>", "The story of the day."),
    ("<main><p>The story <!-- of the day is told here.</p><p>And so is the end of it.</p></main>", "The story of the day is told here.\nAnd so is the end of it."),
    ("<main><p>The story<!--> of the day is told.</p></main>", "The story of the day is told."),
    ("<main><ul><li>One point of the story is this.</li><li>Another point of the story is that.</li></ul></main>", "One point of the story is this.\nAnother point of the story is that."),
    ("<main><p>Before it.<noscript>Within it.</noscript> After it.</p></main>", "Before it.Within it. After it."),
    ("<main><p>The story of the day is told here.<p>And so is the end of it.</main>", "The story of the day is told here.\nAnd so is the end of it."),
    ("<main><table><tr><td>A cell of the table is this.</td><td>Another cell of it is that.</td></tr></table></main>", "A cell of the table is this.\nAnother cell of it is that."),
    ("<main><p>Press <button>Share</button> to go on with the story.</p></main>", "Press to go on with the story."),
    ("<main><p>The story < 3 > 2 of the day.</p></main>", "The story < 3 > 2 of the day."),
    ("<article><p>The first paragraph.</p><p>See <span class='ad'>buy now</p><p>The second paragraph of it.</p><p>The third one of it.</p></article>", "The first paragraph.\nSee\nThe second paragraph of it.\nThe third one of it."),
    ("<article><p>The first paragraph.</p><p>See <button>buy now</p><p>The second paragraph of it.</p><p>The third one of it.</p></article>", "The first paragraph.\nSee\nThe second paragraph of it.\nThe third one of it."),
    ("<article><div class='side-by-side'><p>The story of the day is told here.</p></div><p class='free-form'>And so is the end of it.</p></article>", "The story of the day is told here.\nAnd so is the end of it."),
    ("<article><p>The story of the day is told here.</p><p>See the <a href='/1'>a link</a>, <a href='/2'>another link</a>, and <a href='/3'>third</a></p><ul><li><a href='/4'>One work</a> that is cited.</li><li>See <a href='/5'>another such work</a></li></ul></article>",
     "The story of the day is told here.\nSee the a link, another link, and third\nOne work that is cited.\nSee another such work"),
    ("", ""), (None, ""), ("<p></p>", ""),
]


def test_an_unclosed_inline_element_changes_no_other_paragraph():
    weights, pick = html_extraction.fit_blocks(), random.Random(6)
    for _ in range(200):
        paras = [f"Paragraph number {i} of the story that is told." for i in range(pick.randint(2, 6))]
        at, cut = pick.randrange(len(paras)), pick.randrange(1, 5)
        tag = pick.choice(["<span class='ad'>", "<button>", "<span class='share'>", "<b>", "<a href='/x'>", "<span>", "<button type=x>"])
        words = paras[at].split()
        broken = [f"<p>{' '.join(words[:cut])} {tag}{' '.join(words[cut:])}</p>" if i == at else f"<p>{p}</p>" for i, p in enumerate(paras)]
        got = html_extraction.main_text(f"<nav><a href='/'>Home</a></nav><article>{''.join(broken)}</article>", weights).split("\n")
        assert [p for i, p in enumerate(paras) if i != at] == [x for x in got if x in paras[:at] + paras[at + 1 :]], (tag, got)


def test_pages_by_hand(spark):
    weights = html_extraction.fit_blocks()
    for page, want in PAGES:
        assert html_extraction.main_text(page, weights) == want, page
    long = "<main>" + "".join(f"<p>Paragraph number {i} of the long story.</p>" for i in range(20_000)) + "</main>"
    rows = [(1, "u", long, "text"), (1, "u", long, "text"), (2, None, None, None)]
    out = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), weights).collect()
    assert sorted(r["text"].count("\n") for r in out) == [0, 19_999, 19_999] and [r["url"] for r in out if r["id"] == 2] == [None]
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string"), weights).count() == 0
