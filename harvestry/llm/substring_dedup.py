"""Duplicate substrings by content-defined blocks and exact counts of window hashes.

This is not the greedy relative Lempel-Ziv parse that the operator is dealt: no
match is extended word by word and no (reference, position, length) factor is
made. The README says why. What stands in its place finds the same spans.

Every window of ``window`` words picks an anchor, the ``GRAM``-word gram in it
with the smallest hash (the last on a tie). The choice depends on the window's
words alone, so equal windows pick the same anchor at the same place. Windows in
a row with one anchor form a block: the words from the first window's start to
the last one's end. The blocks of all documents are indexed by (anchor, hash of
the whole block).

A block found elsewhere in the index repeats with every window in it. Where only
its anchor is found elsewhere, a match may stop inside the block: there the
windows themselves are looked up, one representative of each distinct block
against all others with that anchor. The words of repeated windows are the
duplicate spans.

Every lookup is a count by hash with partial aggregation and a join back, so a
passage shared by a third of all documents is folded before the shuffle and
never paired. Hashes identify blocks and windows by 128 bits. The texts are read
again for each step instead of being kept with their hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.llm.common import schema_of, store, whole_text

WINDOW = 35
GRAM = 8
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """Two 64-bit hashes per word, and hashes of word runs from prefix sums."""

    def __init__(self):
        self.powers = self.inverses = np.ones(1, np.uint64)

    def of(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)

    def runs(self, hashes: np.ndarray):
        """run(which, starts, lengths) -> hashes of the word runs at ``starts``."""
        n = len(hashes)
        if len(self.powers) <= n:
            self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, BASE))])
            self.inverses = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, BASE_INVERSE))])
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes[:, c] * self.powers[:n])]) for c in (0, 1)]
        return lambda which, start, length: mixed((sums[which][start + length] - sums[which][start]) * self.inverses[start])


def blocks_of(run, n: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, block hash, first window, last window) of every block of a text of ``n`` >= window words."""
    gram = min(GRAM, window)
    grams = run(0, np.arange(n - gram + 1), gram)
    span = window - gram + 1
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    anchor = np.arange(n - window + 1) + span - 1 - np.argmin(view[:, ::-1], axis=1)
    first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
    last = np.concatenate([first[1:] - 1, [n - window]])
    shape = ((last - first) * 4096 + anchor[first] - first).astype(np.uint64)  # both are under window
    block = mixed(run(1, first, last - first + window) ^ mixed(shape + np.uint64(1)))
    return grams[anchor[first]], block, first, last


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): rows with one (id, h) are the same document word for word."""
    text = whole_text(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _blocks(keyed: DataFrame, window: int, with_place: bool) -> DataFrame:
    places = "id, h, " if with_place else ""
    zero = F.lit(0).cast("long")
    schema = schema_of(keyed.select(zero.alias("anchor"), zero.alias("block"), *(["id", "h"] if with_place else []),
                                    *([zero.cast("int").alias("first"), zero.cast("int").alias("last")] if with_place else [])))

    def run(batches):
        hasher = WordHashes()
        for b in batches:
            out, owner = [], []
            for i, text in enumerate(b.column("text")):
                words = text.as_py().encode().split()
                if len(words) >= window:
                    out.append(blocks_of(hasher.runs(hasher.of(words)), len(words), window))
                    owner.append(np.full(len(out[-1][0]), i))
            if out:
                anchor, block, first, last = (np.concatenate(c) for c in zip(*out))
                cols = [pa.array(anchor.view(np.int64)), pa.array(block.view(np.int64))]
                if places:
                    at = pa.array(np.concatenate(owner))
                    cols += [b.column("id").take(at), b.column("h").take(at), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return keyed.mapInArrow(run, schema)


def _windows(keyed: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """(w1, w2, id, h, at, alone) for every window of the blocks in ``places`` (id, h, first, last, alone)."""
    wanted = places.groupBy("id", "h").agg(F.collect_list(F.struct("first", "last", "alone")).alias("spans"))
    joined = _join_texts(keyed, wanted, "inner")
    zero = F.lit(0).cast("long")
    schema = schema_of(joined.select(zero.alias("w1"), zero.alias("w2"), "id", "h", zero.cast("int").alias("at"), F.lit(True).alias("alone")))

    def run(batches):
        hasher = WordHashes()
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part, out = b.slice(at, 64), []
                for i, (text, spans) in enumerate(zip(part.column("text"), part.column("spans"))):
                    words = text.as_py().encode().split()
                    hashes = hasher.runs(hasher.of(words))
                    spans = spans.as_py()
                    starts = np.concatenate([np.arange(s["first"], s["last"] + 1) for s in spans])
                    alone = np.concatenate([np.full(s["last"] - s["first"] + 1, s["alone"]) for s in spans])
                    out.append((hashes(0, starts, window), hashes(1, starts, window), np.full(len(starts), i), starts, alone))
                w1, w2, owner, starts, alone = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), part.column("id").take(pa.array(owner)),
                     part.column("h").take(pa.array(owner)), pa.array(starts.astype(np.int32)), pa.array(alone)], names=schema.names)

    return joined.mapInArrow(run, schema)


def _join_texts(keyed: DataFrame, by_doc: DataFrame, how: str) -> DataFrame:
    right = by_doc.withColumnsRenamed({"id": "_id", "h": "_h"})
    return keyed.join(right, (F.col("h") == F.col("_h")) & F.col("id").eqNullSafe(F.col("_id")), how).drop("_id", "_h")


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, h, first, last): runs of starts of windows that also start anywhere else, in pieces of a block at most."""
    keyed = _keyed(docs, id_col, text_col)
    anchors = (_blocks(keyed, window, False).groupBy("anchor")
               .agg(F.count(F.lit(1)).alias("n"), F.min("block").alias("b0"), F.max("block").alias("b1")).filter("n > 1")
               .select(F.col("anchor").alias("_anchor"), (F.col("b0") == F.col("b1")).alias("pure")))
    anchors = store(anchors, "spans-anchors")
    found = _blocks(keyed, window, True).join(anchors, F.col("anchor") == F.col("_anchor")).drop("_anchor")
    found = store(found, "spans-blocks")
    inside = found.filter("pure").select("id", "h", "first", "last")
    edge = found.filter("not pure")
    distinct = store(edge.groupBy("anchor", "block").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "h", "first", "last")).alias("one")),
                     "spans-distinct")
    again = edge.join(distinct.filter("n > 1").select("anchor", "block"), ["anchor", "block"], "left_semi").select("id", "h", "first", "last")
    ones = distinct.select("one.id", "one.h", "one.first", "one.last", (F.col("n") == 1).alias("alone"))
    windows = store(_windows(keyed, ones, window), "spans-windows")
    repeated = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w1", "w2")
    at_edge = windows.filter("alone").join(repeated, ["w1", "w2"], "left_semi")
    return inside.unionByName(again).unionByName(at_edge.select("id", "h", F.col("at").alias("first"), F.col("at").alias("last")))


def remove_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: id, n_words, n_removed, spans (array of removed [start, end) word ranges), kept.

    A word goes if it lies in a window of ``window`` words whose word sequence
    also starts anywhere else in the table, the same document included. A null,
    empty or shorter text has no window. ``kept`` is the words that stay, joined
    by one space. Repeated rows are occurrences of each other.
    """
    keyed = _keyed(docs, id_col, text_col)
    spans = factors(docs, id_col, text_col, window).groupBy("id", "h").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    joined = _join_texts(keyed, spans, "left")
    zero = F.lit(0).cast("long")
    schema = schema_of(joined.select("id", zero.alias("n_words"), zero.alias("n_removed"),
                                     F.array(F.struct(zero.alias("start"), zero.alias("end"))).alias("spans"), F.col("text").alias("kept")))

    def run(batches):
        for b in batches:
            rows = []
            for text, runs in zip(b.column("text"), b.column("runs")):
                words = text.as_py().encode().split()
                depth = np.zeros(len(words) + 1, np.int64)
                for r in runs.as_py() or ():
                    depth[r["first"]] += 1
                    depth[min(r["last"] + window, len(words))] -= 1
                gone = np.cumsum(depth[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                rows.append((len(words), int(gone.sum()), [{"start": int(s), "end": int(e)} for s, e in zip(turn[::2], turn[1::2])],
                             b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode()))
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(cols[3], pa.string())],
                names=schema.names)

    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)
