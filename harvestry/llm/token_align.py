"""Cross-tokenizer alignment: which tokens of two tokenizers end at the same byte.

Each text is encoded by a byte-level BPE (A, over a space and the text) and by a
piece BPE with byte fallback (B, over the text; it adds the space). Both give an
ascending array of byte offsets at which tokens end. The arrays are compared by
diagonal run skipping:

1. While both indices advance alike (a fixed shift between them) the ends agree
   for whole stretches. Blocks of 1, 2, 4, ... ends are compared at the current
   shift, each in one memory comparison; the block that differs is halved until
   the first difference is found. The stretch is jumped as one run.
2. At the difference an irregular group starts: whichever side ends first moves on
   until both end together. That sets the new shift.

A link is a pair of tokens that end together. Its count is over the whole corpus:
tasks collect the distinct pairs of a block of documents, so the shuffle carries
one row per block and distinct pair; the counts return to the blocks, which are
bounded by ``BLOCK_PAIRS`` whatever the corpus holds. The pair counts themselves
are joined, not broadcast; only the highest count per B id, at most one row per
entry of B's vocabulary, is.

Null, empty, or not restorable texts (joined token bytes differ from a space and
the text, as when a text holds U+2581) have no tokens: zeros and an empty digest.
Rows that share an id, or have none, give a row each. Ties for the highest count
all count as best. An empty table gives an empty result. Columns other than the
id and the text are ignored, whatever their names. A text costs its task memory in
proportion to its own length.
"""

from __future__ import annotations

import hashlib
import json
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.llm.common import schema_of, store
from harvestry.llm.tokens import BYTE_LETTERS

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Distinct pairs per document, summed, at which a task closes a block.
BLOCK_PAIRS = 1 << 22
SPACE = "▁"


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (into A, into B) of the tokens that end at a byte offset common to both ascending arrays."""
    raw_a, raw_b = ends_a.astype("<i8").tobytes(), ends_b.astype("<i8").tobytes()
    a, b = ends_a.tolist(), ends_b.tolist()
    n, m, i, j, starts, shifts, sizes = len(a), len(b), 0, 0, [], [], []
    while i < n and j < m:
        if a[i] < b[j]:
            i += 1
        elif a[i] > b[j]:
            j += 1
        else:
            k, step, most = 1, 4, min(n - i, m - j)
            while k < most:
                x, y, size = 8 * (i + k), 8 * (j + k), 8 * min(step, most - k)
                block_a, block_b = raw_a[x:x + size], raw_b[y:y + size]
                if block_a != block_b:
                    differ = int.from_bytes(block_a, "little") ^ int.from_bytes(block_b, "little")
                    k += (differ & -differ).bit_length() - 1 >> 6  # the first of these ends that differs
                    break
                k, step = k + (size >> 3), 2 * step
            starts.append(i)
            shifts.append(j - i)
            sizes.append(k)
            i, j = i + k, j + k
    size = np.array(sizes, np.int64)
    at = np.repeat(np.array(starts, np.int64) - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return at, at + np.repeat(np.array(shifts, np.int64), size)


class TokenPair:
    """Both tokenizers, the bytes of their tokens, and their alignment of one text."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        place = lambda name: name if "/" in name else public_tokenizers.path(name)
        letters = {c: b for b, c in BYTE_LETTERS.items()}
        with open(place(byte_bpe), encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters.get(c, ord(c)) for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        merged = [spec["model"]["vocab"]["".join(x.split(" ") if isinstance(x, str) else x)] for x in spec["model"]["merges"]]
        if any(x >= y for x, y in zip(merged, merged[1:])):
            raise ValueError(f"{byte_bpe}: the ids of its merges are not in the order of the merges")
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=place(piece_bpe))
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.bytes_a[i] = t
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
                        for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        ids = max(len(self.bytes_a), len(self.bytes_b))
        self.ids = ids
        self.written = np.frombuffer(b"".join(f"{i}{end}".encode().ljust(8, b"\0") for end in ",|;" for i in range(ids)), "<u8")

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(A ids, B ids, and the indices in each at which groups end), or None where the text has no tokens."""
        if not text:
            return None
        spaced = " " + text
        a, b = self.a.encode_to_numpy(spaced, disallowed_special=()), self.b.encode(text)
        raw = spaced.encode()
        if b"".join(map(self.bytes_b.__getitem__, b)) != raw or self.a.decode_bytes(a.tolist()) != raw:
            return None
        a, b = a.astype(np.int64), np.array(b, np.int64)
        return a, b, *common_ends(np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b]))

    def group_digest(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> str:
        """SHA-256 of the groups as ``a1,a2|b1;a3|b2,b3``."""
        before_b = np.concatenate([[0], at_b[:-1] + 1])
        size_a, size_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
        written = np.empty(len(a) + len(b), np.int64)
        place_a, place_b = np.arange(len(a)) + np.repeat(before_b, size_a), np.arange(len(b)) + np.repeat(at_a + 1, size_b)
        written[place_a], written[place_b] = a, b
        written[place_a[at_a]] += self.ids  # | and ; after the last tokens of a group
        written[place_b[at_b]] += 2 * self.ids
        return hashlib.sha256(self.written[written].tobytes().translate(None, b"\0")[:-1]).hexdigest()


def worker_pair(byte_bpe: str, piece_bpe: str) -> TokenPair:
    """The tokenizers of this Python worker process, made by its first task."""
    kept = sys.modules.setdefault("_token_pairs", types.ModuleType("_token_pairs")).__dict__
    if (byte_bpe, piece_bpe) not in kept:
        kept[(byte_bpe, piece_bpe)] = TokenPair(byte_bpe, piece_bpe)
    return kept[(byte_bpe, piece_bpe)]


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE,
               piece_bpe: str = PIECE_BPE) -> DataFrame:
    """One row per document: id, a_ids, b_ids, and group_ends, the (index in a_ids, index in b_ids) of each group's last tokens."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    none = F.array().cast("array<int>")
    schema = schema_of(slim.select("id", none.alias("a_ids"), none.alias("b_ids"),
                                   F.array().cast("array<struct<a:int,b:int>>").alias("group_ends")))

    def run(batches):
        pair = worker_pair(byte_bpe, piece_bpe)
        ints = pa.list_(pa.int32())
        ends = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            for i in range(batch.num_rows):  # a row at a time: the arrays are larger than the text
                found = pair.encode(batch.column("text")[i].as_py())
                a, b, at_a, at_b = found if found else [np.zeros(0, np.int64)] * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, 1), pa.array([a.tolist()], ints), pa.array([b.tolist()], ints),
                     pa.array([[{"a": x, "b": y} for x, y in zip(at_a.tolist(), at_b.tolist())]], ends)], names=schema.names)

    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _linked(docs: DataFrame, id_col: str, text_col: str, byte_bpe: str, piece_bpe: str, block_pairs: int) -> DataFrame:
    """Rows of two kinds: documents (block, id, measures, which pairs of the block it links and how often) and, with
    ``nth``, the distinct pairs of a block with their number of links in it."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().cast("long").alias("task"))
    zero, raw = F.lit(0).cast("long"), F.lit(b"")
    numbers = ("n_a", "n_b", "n_groups", "n_links")
    schema = schema_of(slim.select(F.col("task").alias("block"), "id", *[zero.alias(c) for c in numbers], F.lit("").alias("groups_sha256"),
                                   raw.alias("uses"), raw.alias("times"), F.lit(0).alias("nth"), F.lit(0).alias("a"), F.lit(0).alias("b"),
                                   zero.alias("n")))

    def run(batches):
        pair = worker_pair(byte_bpe, piece_bpe)
        size_b = len(pair.bytes_b)
        empty = np.zeros(0, np.int64)
        block, ids, rows, held, n_held, id_type = None, [], [], [], 0, None

        def close():
            """The block's documents and pairs; a document names pairs by their place among the block's, as differences."""
            keys = np.concatenate([k for k, _ in held]) if held else empty
            times = np.concatenate([n for _, n in held]) if held else empty
            distinct, place = np.unique(keys, return_inverse=True)
            ends = np.cumsum([len(k) for k, _ in held])
            uses = [np.diff(p, prepend=0).astype("<u4").tobytes() for p in np.split(place, ends[:-1])]
            k = len(ids)
            documents = [pa.array([block] * k, pa.int64()), pa.array(ids, id_type), *[pa.array([r[c] for r in rows], pa.int64()) for c in range(4)],
                         pa.array([r[4] for r in rows], pa.string()), pa.array(uses, pa.binary()),
                         pa.array([n.astype("<u4").tobytes() for _, n in held], pa.binary())]
            yield pa.RecordBatch.from_arrays([*documents, *[pa.nulls(k, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64())]], names=schema.names)
            links = np.bincount(place, times, len(distinct)).astype(np.int64)
            for at in range(0, len(distinct), 1 << 16):
                part = slice(at, at + (1 << 16))
                m = len(distinct[part])
                nothing = [pa.nulls(m, c.type) for c in documents[1:]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, block)), *nothing, pa.array(np.arange(at, at + m, dtype=np.int32)), pa.array((distinct[part] // size_b).astype(np.int32)),
                     pa.array((distinct[part] % size_b).astype(np.int32)), pa.array(links[part])], names=schema.names)

        for batch in batches:
            id_type = batch.schema.field("id").type
            for i in range(batch.num_rows):
                if block is None:
                    block = batch.column("task")[i].as_py() << 32
                found = pair.encode(batch.column("text")[i].as_py())
                if found is None:
                    keys, times, row = empty, empty, (0, 0, 0, 0, "")
                else:
                    a, b, at_a, at_b = found
                    keys, times = np.unique(a[at_a] * size_b + b[at_b], return_counts=True)
                    row = (len(a), len(b), len(at_a), len(at_a), pair.group_digest(*found))
                ids.append(batch.column("id")[i].as_py())
                rows.append(row)
                held.append((keys, times))
                n_held += len(keys) + 1
                if n_held >= block_pairs:
                    yield from close()
                    block, ids, rows, held, n_held = block + 1, [], [], [], 0
        if ids:
            yield from close()

    return slim.mapInArrow(run, schema)


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE,
                piece_bpe: str = PIECE_BPE, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best`` counts the links whose pair is linked more often than, or as often
    as, any other pair of its B id in the corpus; ``count_sum`` adds the corpus
    counts of its links.
    """
    flat = store(_linked(docs, id_col, text_col, byte_bpe, piece_bpe, block_pairs), "align-blocks")
    pairs = flat.filter("nth is not null").select("block", "nth", "a", "b", "n")
    counts = store(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "align-counts")
    highest = counts.groupBy(F.col("b").alias("_b")).agg(F.max("count").alias("highest"))  # at most one row per entry of B's vocabulary
    scored = counts.join(F.broadcast(highest), F.col("b") == F.col("_b")).select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))
    known = pairs.join(scored, ["a", "b"]).select("block", "nth", "count", "best")
    documents = flat.filter("nth is null").select(F.col("block").alias("in_block"), "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "uses", "times")
    zero = F.lit(0).cast("long")
    schema = schema_of(documents.select("id", "n_a", "n_b", "n_groups", "n_links", zero.alias("n_best"), zero.alias("count_sum"), "groups_sha256"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        nth = right.column("nth").to_numpy()
        count, best = np.zeros(len(nth), np.int64), np.zeros(len(nth), bool)
        count[nth], best[nth] = right.column("count").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        n_best, total = [], []
        for uses, times in zip(left.column("uses"), left.column("times")):
            at, n = np.cumsum(np.frombuffer(uses.as_buffer(), "<u4").astype(np.int64)), np.frombuffer(times.as_buffer(), "<u4").astype(np.int64)
            n_best.append(int(n[best[at]].sum()))
            total.append(int(n @ count[at]))
        return left.select(["id", "n_a", "n_b", "n_groups", "n_links"]).append_column("n_best", pa.array(n_best, pa.int64())) \
            .append_column("count_sum", pa.array(total, pa.int64())).append_column("groups_sha256", left.column("groups_sha256"))

    return documents.groupBy("in_block").cogroup(known.groupBy("block")).applyInArrow(score, schema).withColumnRenamed("id", id_col)
