"""Fill-in-the-middle: a text's lines are cut into prefix, middle and suffix and put in another order.

The tokenizers library's ``Split`` pre-tokenizer isolates the units (lines by default) and gives
their code-point offsets; how many there are and where the ranked ones end is all that is needed to
slice the text. Cuts and form follow from a hash of the document's id, so a document gets the same
form on every run and machine. It is a map over the documents; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import table, trim
from .packing import slices

#: A unit is a line with its line feed, or what is left at the end; the marks of the three parts.
UNIT = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Bytes of text that become one batch of output.
_SLICE = 4 << 20


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four unsigned 32-bit numbers of a document; a null id hashes as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def cut(ends: list[int], h: list[int]) -> tuple[int, int]:
    """Code points before the middle and before the suffix, from where the units end."""
    ranks = sorted(x % (len(ends) + 1) for x in h[:2])
    first, second = (ends[k - 1] if k else 0 for k in ranks)
    return first, second


def transformed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = UNIT, seed: int = SEED, rate: int = 100, spm_rate: int = 50,
) -> DataFrame:
    """Per row: ``id``, ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars``, ``output``.

    ``rate`` of 100 texts are transformed, ``spm_rate`` of 100 of these with the suffix first. A text
    that is empty or holds one of the marks stays plain, with null lengths. Null texts are empty
    ones; null ids share one draw; repeated rows give equal rows; texts of any length are cut whole;
    an empty table gives an empty result. Other columns are ignored.
    """

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        split = Split(Regex(unit), behavior="isolated")

        def one(doc_id, text):
            ends = [end for _, (_, end) in split.pre_tokenize_str(text)] if text else []
            h = draws(seed, doc_id)
            if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[2] % 100 >= rate:
                return len(ends), "plain", None, None, text
            a, b = cut(ends, h)
            prefix, middle, suffix = text[:a], text[a:b], text[b:]
            if h[3] % 100 < spm_rate:
                return len(ends), "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
            return len(ends), "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"

        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
        for b in batches:
            for i, j in slices(b.column(1), _SLICE):
                ids = b.column(0).slice(i, j - i)
                made = [one(d, t or "") for d, t in zip(ids.to_pylist(), b.column(1).slice(i, j - i).to_pylist(), strict=True)]
                columns = zip(*made, strict=True) if made else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)
            trim()

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return own.mapInArrow(run, "id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text from which ``output`` was made: the parts between the marks, in their own order."""
    parts = F.split(output, "|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))), -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = transformed(table(spark, sf_dir, "documents"))
    text = restored(F.col("form"), F.col("output"))
    return out.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (
  SELECT doc_id, text, units, len(units) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT doc_id, n, form, text, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:n], ''), '') AS suffix FROM c),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(text) AS restored_sha256
FROM o
"""
