"""The five stages one by one and together, and awkward tables for every operator that filters documents."""

import random

import public_tokenizers
import pytest
from xxhash import xxh64_intdigest

import corpus_pipeline
from panelforge.llm import decontamination, packing, quality, simhash_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus() -> tuple[list, list, list]:
    pick = random.Random(5)
    word = lambda: "".join(pick.choice(("ta", "ri", "mo", "sel", "ka", "du")) for _ in range(pick.randrange(1, 4)))
    good = lambda n: " ".join(word() for _ in range(n)) + "."
    bad = lambda n: " ".join(pick.choice(("$$$", "CLICK", "###", "!!!", "123456")) for _ in range(n))
    texts = {i: good(80) if i % 3 else bad(60) for i in range(180)}
    item = good(30)
    shared = good(60)
    texts |= {300: texts[1], 301: texts[1], 302: good(40) + " " + shared + " " + good(40), 303: good(40) + " " + shared + " " + good(40), 304: good(5) + " " + item}
    rows = [(i, t, "xx", "s", len(t)) for i, t in texts.items()]
    rows += [(400, None, None, None, None), (401, "", "xx", "s", 0), (402, "  ", "xx", "s", 2), (None, good(50), "xx", "s", None), rows[4], (5, good(60), "again", "s", 1)]
    labels = [(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(180)]
    return rows, labels, [("b1", item)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    sf_dir = str(tmp_path_factory.mktemp("sf"))
    rows, labels, items = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    return sf_dir


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["quality_classifier"](spark, docs, tables)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    clean = [i for i in range(180) if i % 3]
    assert set(clean) <= set(ids) and not {i for i in range(180) if i % 3 == 0} & set(ids) and kept.columns == docs.columns
    one = steps["simhash_dedup"](spark, docs, tables)
    left = [r["doc_id"] for r in one.collect()]
    assert 300 not in left and 301 not in left and 1 in left and left.count(4) == 1 and one.columns == docs.columns
    cut = steps["suffix_dedup"](spark, docs, tables)
    got = {r["doc_id"]: r for r in cut.collect()}
    assert cut.schema == docs.schema and cut.count() == docs.count() and got[400]["text"] is None and got[401]["text"] == ""
    assert got[300]["text"] == "" and len(got[303]["text"]) < len(got[302]["text"]) and got[303]["n_chars"] == len(got[303]["text"])
    fine = steps["decontamination"](spark, docs, tables)
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in fine.collect()} == {304} and fine.columns == docs.columns
    placed = steps["best_fit_packing"](spark, docs, tables).collect()
    ends = {}
    for r in placed:
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in ends.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_and_empty_tables(spark, tables, tmp_path):
    out = corpus_pipeline.run(spark, tables).collect()
    ids = {r["doc_id"] for r in out}
    assert {i for i in range(180) if i % 3} <= ids and not {0, 3, 300, 301, 304} & ids
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0, name


def test_clashing_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    clash = docs.selectExpr("*", "'a' as panelforge_score", "'b' as id", "'c' as kept", "1 as shard", "'d' as carried", "'e' as fp")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, tables)
        assert out.columns == clash.columns, name
        assert {(r["panelforge_score"], r["id"], r["kept"], r["carried"], r["fp"]) for r in out.collect()} == {("a", "b", "c", "d", "e")}, name


def simhash(text: str, shingle: int = 4) -> int:
    """Bit by bit, from the definition."""
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    ones = [sum(xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def test_fingerprints_by_definition():
    pick = random.Random(8)
    texts = [None, "", " \t", "a", "A b", "a B c", "É é Ⅷ"] + [" ".join(pick.choice(["A", "b", "ñ", "Éa", "x\u00a0y", "7"]) for _ in range(pick.randrange(1, 80))) for _ in range(150)]
    for t in texts:
        assert simhash_dedup.fingerprint(None if t is None else t.encode()) == simhash(t)


def test_awkward_tables(spark, tables):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns, no rows."""
    rows, labels, items = corpus()
    long = " ".join(f"w{i}" for i in range(200_000))
    docs = spark.createDataFrame([(*r, "clash") for r in [*rows, (500, long, "xx", "s", 1)]], SCHEMA + ", score string")
    none = docs.limit(0)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for fit, score in ((quality.fit_quality, lambda d, m: quality.score_quality(d, m).select("doc_id", "score")), (toxicity.fit_toxicity, lambda d, m: toxicity.score_toxicity(d, m).withColumnRenamed("id", "doc_id"))):
        model = fit(docs, marks)
        out = score(docs, model).collect()
        assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
        twice = [r["score"] for r in out if r["doc_id"] == 4]
        assert len(twice) == 2 and twice[0] == twice[1]
        assert score(none, model).count() == 0
        assert score(docs, fit(none, marks)).count() == docs.count()
    made = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sum(r["length"] for r in made if r["id"] == 500) > 200_000 and len([r for r in made if r["id"] == 400]) == 1
    bench = spark.createDataFrame([*items, (None, None), ("long", long), ("b1", items[0][1])], "item_id string, text string")
    out = {r["id"]: r for r in decontamination.contamination(docs, bench).collect()}
    assert out[500]["contaminated"] and out[500]["n_hit"] == 200_000 and out[304]["items"] == ["b1"] and not out[400]["contaminated"]
    assert decontamination.contamination(none, bench).count() == 0
    assert not any(r["contaminated"] for r in decontamination.contamination(docs, bench.limit(0)).collect())
    groups = {r["id"]: r["component"] for r in simhash_dedup.near_duplicates(docs).collect()}
    assert groups[300] == groups[301] == 1 and groups[400] == groups[401] == groups[402] == 400 and groups[500] == 500
