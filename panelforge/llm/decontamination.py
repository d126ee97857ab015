"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

The index holds (term, document, position) for the terms that searches start from. A phrase is
looked up by its two rarest terms: the offset-adjusted lists are intersected, and what is left is
compared with the text. Term counts cover all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import checkpointed, table, unused

#: What separates words: ASCII but digits and letters. Other characters belong to words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A side of a join is broadcast up to so many bytes of text and numbers; beyond, it is shuffled.
BROADCAST_BYTES = 24 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(word: Column) -> Column:
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _UPPER.lower()))


def _split(df: DataFrame, text_col: str) -> DataFrame:
    """``raw``: the text's words in their own case, with an empty string where it begins or ends in a separator."""
    raw = F.split(F.coalesce(F.col(text_col), F.lit("")), SEPARATORS)
    out = df.withColumn("raw", raw)
    first, last = F.element_at("raw", 1) == "", F.element_at("raw", -1) == ""
    lead = F.when(first, 1).otherwise(0)
    return out.withColumn("lead", lead).withColumn("n_words", (F.size("raw") - F.col("lead") - F.when(last & (F.size("raw") > 1), 1).otherwise(0)).cast("long"))


def tokens(docs: DataFrame, text_col: str = "text", *keep: str) -> DataFrame:
    """One row per word: ``keep`` columns, ``pos`` from 0 and ``term`` in lower case."""
    out = _split(docs, text_col).select(*keep, "lead", F.posexplode("raw").alias("p", "w")).filter("w <> ''")
    return out.select(*keep, (F.col("p") - F.col("lead")).alias("pos"), lower_ascii(F.col("w")).alias("term"))


def _small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if all its rows together are small; words have no bound, so their bytes count."""
    width = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("array"):
            size = F.aggregate(c, F.lit(0).cast("long"), lambda n, w: n + F.coalesce(F.octet_length(w.cast("string")), F.lit(0)) + 16)
        else:
            size = F.octet_length(c) if kind in ("string", "binary") else F.lit(0)
        width = width + F.coalesce(size, F.lit(0)) + 16
    total = df.agg(F.coalesce(F.sum(width), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def phrases(items: DataFrame, id_col: str, text_col: str, length: int) -> tuple[DataFrame, DataFrame]:
    """The distinct phrases (``gram``, ``words``) of all items, and which item has which."""
    words = _split(items.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").alias("text")), "text").filter("n_words > 0")
    words = words.select("item", F.transform(F.slice("raw", F.col("lead") + 1, F.col("n_words").cast("int")), lower_ascii).alias("words"))
    last = F.greatest(F.size("words") - length, F.lit(0))
    grams = words.select("item", F.explode(F.sequence(F.lit(0), last)).alias("i"), "words").select("item", F.slice("words", F.col("i") + 1, length).alias("words"))
    grams = checkpointed(grams.select("item", F.array_join("words", " ").alias("gram"), "words").distinct())
    return grams.select("gram", "words").distinct(), grams.select("item", "gram").distinct()


def rarest(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, words, term1, at1, term2, at2): the phrase's two rarest terms and where they stand.

    A phrase with a term that no document has is left out; a phrase of one word has no second.
    """
    each = grams.select("gram", "words", F.posexplode("words").alias("at", "term")).join(counts, "term", "left")
    order = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "term")
    picked = each.groupBy("gram").agg(F.first("words").alias("words"), F.array_sort(F.collect_list(order)).alias("by"))  # a phrase's own words
    picked = picked.filter(F.element_at("by", 1)["n"] > 0)
    one, two = F.element_at("by", 1), F.try_element_at("by", F.lit(2))
    return picked.select("gram", "words", one["term"].alias("term1"), one["at"].alias("at1"), two["term"].alias("term2"), two["at"].alias("at2"))


def postings(docs: DataFrame, terms: DataFrame, *keep: str) -> DataFrame:
    """The positional index of ``terms``: ``keep`` columns that name the document, ``term``, ``pos``."""
    return tokens(docs, "text", *keep).join(terms, "term", "left_semi")


def phrase_matches(docs: DataFrame, grams: DataFrame, *key: str) -> DataFrame:
    """Every exact occurrence: ``key`` columns of the document, ``gram``, ``start`` and ``size`` in words."""
    terms = checkpointed(grams.select(F.explode("words").alias("term")).distinct())
    counts = checkpointed(tokens(docs).join(_small(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n")))
    plan = checkpointed(rarest(grams, counts))
    wanted = plan.select(F.col("term1").alias("term")).unionByName(plan.select(F.col("term2").alias("term"))).filter("term is not null").distinct()
    index = checkpointed(postings(docs, _small(wanted), *key))
    look = plan.select("gram", "term1", "at1", "term2", "at2")
    starts = index.join(_small(look), F.col("term") == F.col("term1")).select(*key, "gram", (F.col("pos") - F.col("at1")).alias("start"), "term2", "at2").filter("start >= 0")
    second = index.select(*key, F.col("term").alias("term2"), F.col("pos").alias("pos2"))
    pairs = starts.filter("term2 is not null").withColumn("pos2", F.col("start") + F.col("at2")).join(second, [*key, "term2", "pos2"], "left_semi")
    found = pairs.select(*key, "gram", "start").unionByName(starts.filter("term2 is null").select(*key, "gram", "start"))
    found = checkpointed(found)
    # the rest of the phrase is compared with the text of the documents that are left
    there = found.select(*key).distinct()
    texts = docs.join(_small(there), list(key), "left_semi").dropDuplicates(list(key))
    each = found.join(_small(plan.select("gram", "words")), "gram").groupBy(*key).agg(F.collect_list(F.struct("gram", "start", "words")).alias("tries"))  # a document's own places
    both = _split(texts, "text").join(each, list(key))
    same = lambda t: F.transform(F.slice("raw", t["start"] + F.col("lead") + 1, F.size(t["words"])), lower_ascii) == t["words"]
    hits = both.select(*key, F.explode(F.filter("tries", same)).alias("t"))
    return hits.select(*key, F.col("t.gram").alias("gram"), F.col("t.start").alias("start"), F.size("t.words").alias("size"))


def proximity_matches(docs: DataFrame, pairs: DataFrame, within: int, *key: str) -> DataFrame:
    """Places where the terms ``a`` and ``b`` of a pair stand at most ``within`` words apart.

    All such places are matched: blocks of ``within`` words make the join an equi-join, so the rows
    grow with the places and their matches. Returns ``key`` columns, ``a``, ``b``, ``pos`` and ``other``.
    """
    wanted = pairs.select(F.col("a").alias("term")).unionByName(pairs.select(F.col("b").alias("term"))).distinct()
    index = checkpointed(postings(docs, _small(wanted), *key))
    pairs, block = pairs.select("a", "b").distinct(), F.floor(F.col("pos") / max(within, 1))
    left = index.join(_small(pairs), F.col("term") == F.col("a")).select(*key, "a", "b", "pos", block.alias("block"))
    right = index.join(_small(pairs), F.col("term") == F.col("b")).select(
        *[F.col(k).alias(f"{k}_b") for k in key], F.col("a").alias("first"), F.col("b").alias("second"), F.col("pos").alias("other"), F.explode(F.sequence(block - 1, block + 1)).alias("near"),
    )
    on = (F.col("a") == F.col("first")) & (F.col("b") == F.col("second")) & (F.col("block") == F.col("near")) & (F.abs(F.col("pos") - F.col("other")) <= within)
    for k in key:
        on &= F.col(k).eqNullSafe(F.col(f"{k}_b"))
    return left.join(right, on).select(*key, "a", "b", "pos", "other")


def _keys(id_col: Column, text: Column) -> tuple[Column, Column]:
    """Two numbers that name a row by its id and text, none of them null."""
    return F.coalesce(F.xxhash64(id_col), F.lit(0)), F.xxhash64(text, id_col)


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    length: int = 13, share: int = 20, keys: bool = False,
) -> DataFrame:
    """One row per input row: ``id``, ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted as strings), ``contaminated``.

    A phrase is ``length`` consecutive words of an item, or all words of a shorter one. A document
    word is hit if an occurrence of a phrase covers it. Contaminated: at least one word in
    ``share`` is hit. Null texts have no words; items without words match nothing; rows that are
    equal in id and text have equal results; no documents give no rows, no items no hits. Texts are
    read whole, however long. Other columns are ignored.
    """
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    own = own.withColumns(dict(zip(("k1", "k2"), _keys(F.col("id"), F.col("text")), strict=True)))
    grams, owners = phrases(items, item_col, item_text, length)
    hits = checkpointed(phrase_matches(own, grams, "k1", "k2"))
    w = Window.partitionBy("k1", "k2").orderBy("start", "size")
    end = F.col("start") + F.col("size")
    done = F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = hits.select("k1", "k2", F.greatest(F.lit(0), end - F.greatest("start", done)).alias("n")).groupBy("k1", "k2").agg(F.sum("n").alias("n_hit"))
    held = hits.select("k1", "k2", "gram").distinct().join(_small(owners), "gram").select("k1", "k2", F.col("item").cast("string").alias("item")).distinct()
    held = held.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("item")).alias("items"))  # at most all items
    sizes = _split(own, "text").select("id", "k1", "k2", "n_words")
    out = sizes.join(covered.join(held, ["k1", "k2"]), ["k1", "k2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_held = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "id", "n_words", n_hit.alias("n_hit"), F.size(items_held).cast("long").alias("n_items"), items_held.alias("items"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), *["k1", "k2"] * keys,
    )


def decontaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", length: int = 13, share: int = 20,
) -> DataFrame:
    """``docs`` without the contaminated rows (see :func:`contamination`), all columns kept."""
    judged = contamination(docs, items, id_col, text_col, item_col, item_text, length, share, keys=True)
    one, two = unused(docs, "panelforge_k1"), unused(docs, "panelforge_k2")
    bad = checkpointed(judged.filter("contaminated").select(F.col("k1").alias(one), F.col("k2").alias(two)).distinct())
    keyed = docs.withColumns(dict(zip((one, two), _keys(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")), strict=True)))
    return keyed.join(_small(bad), [one, two], "left_anti").drop(one, two)


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (SELECT item_id, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i FROM b WHERE len(words) > 0),
g AS (SELECT DISTINCT item_id, list_slice(words, i, i + 12) AS gram FROM bw),
sizes AS (SELECT DISTINCT len(gram) AS n FROM g),
dw AS (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, sizes WHERE len(words) >= n),
h AS (SELECT dw.doc_id, dw.i, dw.n, g.item_id FROM dw JOIN g ON list_slice(dw.words, dw.i, dw.i + dw.n - 1) = g.gram),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
