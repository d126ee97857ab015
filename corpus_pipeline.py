"""From raw documents to packed sequences: five stages, each calling one operator.

Every stage reads what its predecessor kept, as Parquet; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.llm import decontamination, packing, quality, simhash_dedup, suffix_dedup
from panelforge.llm.common import crc_mod, shared_folder, table, unused

#: Documents with a lower score go.
LEAST_QUALITY = 0.3
TOKENIZER = "word_bpe_49k.json"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null and empty texts are scored by their (zero) statistics, repeated rows alike; an empty table
    gives an empty one. All columns stay.
    """
    score = unused(docs, "panelforge_score")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), learn=crc_mod("doc_id", 5) != 0)
    return quality.score_quality(docs, model, column=score).filter(F.col(score) >= LEAST_QUALITY).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link: the smallest id (null last).

    Null and empty texts have one fingerprint, so one of them stays; of equal rows one stays; an
    empty table gives an empty one. All columns stay.
    """
    return simhash_dedup.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what a smaller document id holds; bytes that are no longer a character go, ``n_chars`` follows.

    Null texts stay null, null ids rank after all others, repeated rows stay alike; an empty table
    gives an empty one. Other columns are carried along unchanged.
    """
    out = suffix_dedup.remove_repeated_bytes(docs, carry=[c for c in docs.columns if c != "text"], decode=True)
    changed = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast(docs.schema["n_chars"].dataType)}
    return out.select(*[changed.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold benchmark text beyond the limit.

    Null and empty texts stay, equal rows go or stay together; an empty table gives an empty one,
    an empty benchmark removes nothing. All columns stay.
    """
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences.

    Null and empty texts are one token, long ones are cut, equal rows are packed as often as they
    occur; an empty table gives an empty one. Other columns are ignored.
    """
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path(TOKENIZER)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: SQL can express neither the classifier nor the fingerprints nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them tables in the cluster's shared folder."""
    own = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{own}/{name}")
        docs = spark.read.parquet(f"{own}/{name}")
    return docs
