"""Aligning the tokens of two tokenizers by their bytes, and how often token pairs are linked in a corpus.

Two tokenizers cut the same bytes at different places. A transducer walks over both token
sequences: the side that is ahead has a residual, its bytes that the other side hasn't reached yet;
the side behind gives the next token, and where the residual becomes empty a group closes. What a
token does to a residual doesn't depend on where it happens, so transitions are remembered by
(residual, token). Words between two spaces are independent in both tokenizers used here, so whole
words are remembered too, and a document is a gather over the entries of its words.

The tokens whose byte ranges end together, the last ones of a group, are linked. Counting links over
the corpus is a Spark aggregation over (document, pair) rows, and so is what the counts say about a
document.
"""

from __future__ import annotations

import json
import os
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, table, trim
from .packing import _laid, slices

#: Words that a Python worker remembers, twice: those in use and those used before them.
_CACHED = 100_000
#: Transitions that a Python worker remembers.
_STEPS = 1_000_000
#: Bytes of text that are aligned together.
_SLICE = 2 << 20
#: A table of pair counts up to this size is broadcast; larger ones are shuffled.
BROADCAST_BYTES = 64 << 20
#: Bytes of a row of that table in memory, about.
_ROW = 56
#: A pair in more than this share of all (document, pair) rows is hot; there are fewer than 1 / share of them.
_HOT = 1 / 2000


class Transducer:
    """Walks over two token sequences of the same bytes; ``left`` and ``right`` are the tokens' bytes by id.

    A state is a residual and the side that it belongs to; state 0 is the empty residual, where the
    left side goes first. The side that is behind gives the next token.
    """

    def __init__(self, left: list[bytes], right: list[bytes]):
        self.sides = (left, right)
        self.states: list[tuple[int, bytes]] = [(1, b"")]  # (side that leads, residual)
        self.number = {(1, b""): 0}
        self.steps: dict[tuple[int, int], int] = {}

    def _step(self, state: int, token: int) -> int:
        """The state after ``token`` of the side that is behind; -1 if bytes differ."""
        lead, residual = self.states[state]
        data = self.sides[1 - lead][token]
        if not data:
            return -1
        if len(data) < len(residual):
            new = (lead, residual[len(data) :]) if residual.startswith(data) else None
        elif data == residual:
            new = (1, b"")
        else:
            new = (1 - lead, data[len(residual) :]) if data.startswith(residual) else None
        if new is None:
            return -1
        if new not in self.number:
            self.number[new] = len(self.states)
            self.states.append(new)
        return self.number[new]

    def groups(self, a: list[int], b: list[int]) -> list[tuple[list[int], list[int]]] | None:
        """The least groups of tokens with equal bytes; None if the sequences' bytes differ."""
        if len(self.steps) > _STEPS:
            self.steps.clear()
            del self.states[1:]
            self.number = {(1, b""): 0}
        steps, states = self.steps, self.states
        out = []
        state = i = j = i0 = j0 = 0
        try:
            while i < len(a) or j < len(b):
                if states[state][0]:  # the right side leads
                    token = a[i]
                    i += 1
                else:
                    token = b[j]
                    j += 1
                key = (state, token)  # the state says whose token it is
                state = steps.get(key, -2)
                if state == -2:
                    state = steps[key] = self._step(*key)
                if state == 0:
                    out.append((a[i0:i], b[j0:j]))
                    i0, j0 = i, j
                elif state < 0:
                    return None
        except IndexError:  # one side ends before the other
            return None
        return out if state == 0 else None


def _byte_alphabet() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(rest)}


class Aligner:
    """Both tokenizers, and what is remembered of words."""

    def __init__(self, byte_tokenizer: str, piece_tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_tokenizer)
        self.a.encode_special_tokens = True  # their strings in a text are text
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_tokenizer)
        of = _byte_alphabet()
        left = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for entry, i in self.a.get_vocab(with_added_tokens=True).items():
            left[i] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        right = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.transducer, self.left, self.width = Transducer(left, right), left, len(pieces)
        self.space = self.b.piece_to_id("▁")
        self.by_words = self._words_are_independent(byte_tokenizer, piece_tokenizer, pieces)
        self.known: dict[bytes, tuple] = {}
        self.before: dict[bytes, tuple] = {}

    @staticmethod
    def _words_are_independent(byte_tokenizer: str, piece_tokenizer: str, pieces: list[str]) -> bool:
        """Whether no token of either tokenizer can lie on both sides of a space that follows a character which isn't white space."""
        from sentencepiece import sentencepiece_model_pb2

        with open(byte_tokenizer) as f:
            own = json.load(f)
        model = sentencepiece_model_pb2.ModelProto()
        with open(piece_tokenizer, "rb") as f:
            model.ParseFromString(f.read())
        n, split = model.normalizer_spec, own["pre_tokenizer"] or {}
        plain = n.name == "identity" and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces
        return bool(
            plain and model.trainer_spec.model_type == model.trainer_spec.BPE and not any("▁" in p.lstrip("▁") for p in pieces)
            and own["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space"))

    def _new(self, chunks: list[bytes]) -> dict[bytes, tuple]:
        """Per chunk (it begins with a space): tokens of either side, groups as text, pairs; all empty but a flag where bytes differ."""
        texts = [c.decode("utf-8", "replace") for c in chunks]
        encoded = self.a.encode_batch_fast(texts, add_special_tokens=False)
        bs = self.b.encode([t[1:] for t in texts], num_threads=1)  # it adds the space itself
        out, left, width = {}, self.left, self.width
        for chunk, e, b in zip(chunks, encoded, bs, strict=True):
            a, b = e.ids, b or [self.space]  # nothing is added to an empty text
            made = self.transducer.groups(a, b) if b"".join([left[i] for i in a]) == chunk else None
            if made is None:
                out[chunk] = (0, 0, 0, b"", b"", False)
                continue
            text = ";".join([f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in made])
            pairs = np.array([x[-1] * width + y[-1] for x, y in made], np.int64).tobytes()
            out[chunk] = (len(a), len(b), len(made), text.encode(), pairs, True)
        return out

    def entries(self, chunks: list[bytes]) -> list[tuple]:
        known, before = self.known, self.before
        made = self._new([c for c in chunks if c not in known and c not in before])
        out = [made[c] if c in made else known[c] if c in known else before[c] for c in chunks]
        if len(known) + len(made) > _CACHED:
            self.known, self.before = {}, known
        self.known.update(zip(chunks, out, strict=True))
        return out


def _chunk_starts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where independent chunks of ``data`` start: at ``first``, and at each space behind a character that isn't white space."""
    at = np.flatnonzero(data == 0x20)
    at = at[at > 2]
    one, two, three = data[at - 1], data[at - 2], data[at - 3]
    plain = (one > 0x20) & (one < 0x7F)
    # white space beyond ASCII ends in one of these bytes, behind C2 or in three bytes from E1, E2 or E3 on
    odd = (one <= 0x8A) | np.isin(one, (0x9F, 0xA0, 0xA8, 0xA9, 0xAF))
    maybe = odd & ((two == 0xC2) | ((two >= 0x80) & (two < 0xC0) & (three >= 0xE1) & (three <= 0xE3)))
    return np.union1d(first, at[plain | ((one >= 0x80) & ~maybe)])


@cache
def _aligner(byte_tokenizer: str, piece_tokenizer: str) -> Aligner:
    """One per Python worker."""
    return Aligner(byte_tokenizer, piece_tokenizer)


_MADE = "id long, n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<long>"


def _aligned(own: Aligner, texts: pa.Array) -> list[pa.Array]:
    """The columns behind ``id`` for some texts."""
    n = len(texts)
    texts = pc.fill_null(texts, "")
    full = np.flatnonzero(pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    n_a, n_b, n_groups = (np.zeros(n, np.int64) for _ in range(3))
    groups, pairs, times, sizes = [""] * n, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    if len(full):
        some = pc.binary_join_element_wise(" ", texts.take(pa.array(full)), "").cast(pa.large_binary())
        ends = np.frombuffer(some.buffers()[1], np.int64, len(full) + 1, some.offset * 8)
        data = np.frombuffer(some.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        first = ends[:-1] - ends[0]
        starts = _chunk_starts(data, first) if own.by_words else first
        offsets = np.append(starts, len(data))
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        entries = own.entries(chunks.dictionary.to_pylist())
        code = chunks.indices.to_numpy()
        begin = np.searchsorted(starts, first)  # each document's first chunk
        number = np.array([e[:3] for e in entries], np.int64).reshape(-1, 3)
        right = np.logical_and.reduceat(np.array([e[5] for e in entries])[code], begin)
        sums = np.add.reduceat(number[code], begin, axis=0) * right[:, None]
        n_a[full], n_b[full], n_groups[full] = sums.T
        text, edge = [e[3] for e in entries], [*begin.tolist(), len(code)]
        listed = code.tolist()
        for k, doc in enumerate(full.tolist()):
            if right[k]:
                groups[doc] = b";".join([text[c] for c in listed[edge[k] : edge[k + 1]]])
        # links by document and pair
        flat = np.frombuffer(b"".join([e[4] for e in entries]), np.int64)
        many = number[:, 2]
        at = np.cumsum(many) - many
        doc = np.repeat(np.arange(len(full)), np.diff(edge))
        kept = right[doc]
        code, doc = code[kept], doc[kept]
        links = _laid(flat, at[code], many[code])
        order = np.lexsort((links, doc_of := np.repeat(doc, many[code])))
        links, doc_of = links[order], doc_of[order]
        new = np.flatnonzero(np.append(True, (links[1:] != links[:-1]) | (doc_of[1:] != doc_of[:-1]))) if len(links) else np.zeros(0, np.int64)
        pairs, times = links[new], np.diff(np.append(new, len(links)))
        sizes[full] = np.bincount(doc_of[new], minlength=len(full))
    at = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    return [pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(groups, pa.string()), pa.ListArray.from_arrays(at, pa.array(pairs)), pa.ListArray.from_arrays(at, pa.array(times))]


def alignments(docs: DataFrame, byte_tokenizer: str, piece_tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id``, ``n_a``, ``n_b``, ``n_groups``, ``groups``, ``pairs``, ``times``.

    A space and the text are encoded by ``byte_tokenizer`` (byte-level vocabulary of the tokenizers
    library; side a), the text by ``piece_tokenizer`` (sentencepiece, which adds the space; side b).
    Both are files that every executor has. ``groups`` is like ``1,2|7;3|8,9``: ids of a and b whose
    bytes are equal, cut as often as possible. ``pairs`` holds the distinct linked pairs as
    ``a * size of b's vocabulary + b`` and ``times`` how often each is linked in this text.

    Null and empty texts and texts whose tokens don't have the text's bytes have no tokens: zeros
    and empty values. Texts of any length are aligned whole; rows with null or repeated ids are
    aligned like others; an empty table gives an empty result. Other columns are ignored.
    """

    def run(batches):
        aligner = _aligner(byte_tokenizer, piece_tokenizer)
        for b in batches:
            for i, j in slices(b.column(1), _SLICE):
                columns = _aligned(aligner, b.column(1).slice(i, j - i))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *columns], ["id", "n_a", "n_b", "n_groups", "groups", "pairs", "times"])
            trim()

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return own.mapInArrow(run, _MADE)


def link_counts(made: DataFrame) -> DataFrame:
    """Per linked pair: ``pair``, ``n`` (links in all documents), ``n_rows`` (documents with one).

    Each task adds up its own documents' links first, so the shuffle has a row for a pair and task.
    """
    rows = made.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.*")
    return rows.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"), F.count("*").alias("n_rows"))


def best_pairs(counts: DataFrame, width: int) -> DataFrame:
    """``counts`` with ``best``: whether no other pair of the same b is linked more often.

    The highest counts are one row for each b, so at most ``width`` rows.
    """
    b = F.pmod("pair", F.lit(width))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    out = counts.withColumn("b", b).join(F.broadcast(most), "b")  # ``width`` rows, a vocabulary
    return out.select("pair", "n", "n_rows", (F.col("n") == F.col("most")).alias("best"))


def link_scores(made: DataFrame, row: str, scored: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per ``row`` with links: ``n_best`` (links of best pairs) and ``count_sum`` (of the links' counts).

    The table of pairs is broadcast if it is small. If not, the pairs that very many documents share
    (fewer than 1 / _HOT) are, and only the rest are shuffled by pair.
    """
    size = scored.agg(F.count("*").alias("pairs"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows")).first()
    links = made.select(F.col(row).alias("row"), F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    own = scored.select("pair", "n", "best")
    if size["pairs"] * _ROW <= broadcast_bytes:
        known = links.join(F.broadcast(own), "pair")
    else:
        hot = F.col("n_rows") > size["rows"] * _HOT
        often, seldom = scored.filter(hot).select("pair", "n", "best"), scored.filter(~hot).select("pair", "n", "best")
        some = F.broadcast(often)  # fewer than 1 / _HOT rows
        known = links.join(some, "pair").unionByName(links.join(some, "pair", "left_anti").join(seldom, "pair"))
    known = known.select("row", "times", "n", F.when(F.col("best"), F.col("times")).otherwise(0).alias("b"))
    return known.groupBy("row").agg(F.sum("b").alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))


def _vocabulary_size(piece_tokenizer: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_tokenizer).get_piece_size()


def scored_alignments(docs: DataFrame, byte_tokenizer: str, piece_tokenizer: str, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """:func:`alignments` without the groups' text and links, with its sha256 and the corpus's word on the links.

    Per row: ``id``, ``n_a``, ``n_b``, ``n_groups``, ``groups_sha256`` (empty without tokens),
    ``n_links``, ``n_best``, ``count_sum``. Awkward rows are as in :func:`alignments`; equal rows
    each count as documents of the corpus.
    """
    made = alignments(docs, byte_tokenizer, piece_tokenizer, id_col, text_col)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    made = checkpointed(made.select("id", "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "pairs", "times", F.monotonically_increasing_id().alias("row")))
    scored = checkpointed(best_pairs(link_counts(made), _vocabulary_size(piece_tokenizer)))
    scores = link_scores(made, "row", scored, broadcast_bytes)
    out = made.select("row", "id", "n_a", "n_b", "n_groups", "groups_sha256").join(scores, "row", "left")
    zero = F.lit(0).cast("long")
    # a group has one last token of either side, and only these end together
    return out.select("id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = scored_alignments(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumnRenamed("id", "doc_id")
