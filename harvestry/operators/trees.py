"""M2–M5: regression trees on binned features, forests and boosters by one learner.

* **Features are binned once** to bytes (``bin_edges``: quantiles in one aggregate)
  and written as blocks of rows, feature by feature (``write_blocks``).
* **Large nodes grow by histogram.** A pass over the blocks adds up (rows, weight,
  gradient) per (node, feature, bin), for the bins that a feature has. Only the smaller
  child of each split is counted; the task that merges a feature subtracts it from the
  parent's histogram of the pass before. A pass runs on RDDs of blocks: boosters make
  thousands, so a pass costs no planning and writes no files. Where the tasks' histograms
  together are at most ``DRIVER_BYTES`` (one booster on tens of cores; their size does
  not depend on the rows) the driver adds them up and the pass is one stage, else they
  are shuffled by feature. Nodes that best-first growth can no longer reach are not counted.
* **Small work is finished by one task.** A learner on at most ``LOCAL_ROWS`` rows is spread
  by its trees: the blocks go once to each task, which grows a share of a forest's trees, or
  all trees of a booster, which need each other; the learners of a cross-validation run side
  by side. A larger forest's node of so many rows is grown by the one task that gets its rows.
  A larger booster makes a pass per level of a tree and moves no rows; a larger forest some
  log2(rows / LOCAL_ROWS) + 1 passes whatever its depth.
* **Large learners advance together.** All boosters, and their cross-validation learners
  (each leaves out one fold of the same blocks), share every pass, so five folds cost
  no further passes; the trees of a forest are all grown in the same passes.
* **A lost executor repeats its own tasks.** Scores are brought up to date tree by tree in
  a persisted RDD, of which the one before is dropped, and written every ``REWRITE``
  trees, so that at most so many trees are applied again.

Growth policies (``Growth``): by level to a depth; best first up to a number of
leaves (exact: the candidates of a level are all known before leaves are chosen);
with L2 in gains and leaf values; with row and feature samples per tree; forests by
Poisson bootstrap. The driver holds boosters' trees, whose size depth and leaves bound. A
forest's trees grow with the rows: tasks write them, and a large forest stays in its files.
"""

from __future__ import annotations

import heapq
import math
import re
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from harvestry.session import shared_path, write_parquet

# Functions travel to the Python workers by value, so that those need numpy and pyarrow alone.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 256
BLOCK_ROWS = 1 << 13
#: Rows of blocks that a task counts at once.
JOINED_ROWS = 1 << 16
#: A forest's node or tree, or a booster, of at most this many rows (a byte per feature and row) is grown by one task.
LOCAL_ROWS = 1 << 19
#: Trees between two writes of the scores.
REWRITE = 32
#: Nodes whose histograms one pass holds in a task; a level with more takes several passes.
PASS_NODES = 2048
#: Histograms of one pass, from all tasks, that the driver adds up itself; more are shuffled.
DRIVER_BYTES = 32 << 20
#: Rows that are counted at a time for all features, few enough for a core's cache.
CHUNK_ROWS = 1 << 15
#: Leaves of a tree that one word of bits holds, and the constant that numbers its lowest bit.
LEAF_BITS = 64
DE_BRUIJN = np.uint64(0x03F79D71B4CB0A89)
#: Tasks that finish nodes, at most.
FINISHERS = 4096
#: Nodes of a level up to which splits are looked for in whole histograms, not in their filled cells.
FEW_NODES = 128
#: Nodes of one learner whose histograms one task holds.
DENSE_NODES = 1024
#: Nodes of a forest that the driver holds, at most; a larger forest stays in the files that its tasks write.
DRIVER_NODES = 1 << 21
#: Trees are finished so many at a time that each core gets this many nodes.
NODES_A_CORE = 2
#: Rows that a task sends through the files of a forest at once.
FOREST_ROWS = 1 << 17


@dataclass(frozen=True)
class Growth:
    """How trees grow. ``rate`` None makes a forest: trees independent of each other, their mean the prediction."""
    trees: int
    depth: int
    rate: float | None = None
    leaves: int | None = None
    min_rows: int = 1
    min_weight: float = 0.0
    l2: float = 0.0
    rows: float = 1.0
    features: float = 1.0
    seed: int = 42


@dataclass(frozen=True)
class Learner:
    """A growth policy on the training rows outside fold ``without``."""
    growth: Growth
    without: int | None = None


@dataclass
class Tree:
    """Nodes in arrays; the children of node i are left[i] and left[i] + 1, a leaf has left -1. A row goes right where its bin is above ``bin``."""
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaf_of(self, x: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each column of ``x`` (features by rows)."""
        n = x.shape[1]
        at, todo = np.zeros(n, np.int32), np.arange(n)
        while len(todo):
            todo = todo[self.left[at[todo]] >= 0]
            here = at[todo]
            at[todo] = self.left[here] + (x[self.feature[here], todo] > self.bin[here])
        return at


# ---------------------------------------------------------------------------
# Binned blocks
# ---------------------------------------------------------------------------

def bin_edges(assembled: DataFrame, n_features: int, bins: int = BINS) -> list[np.ndarray]:
    """Ascending upper edges of the bins of each feature, at most ``bins`` - 1, from quantiles of one aggregate."""
    a = F.col("a")  # a column of its own, or each quantile would unpack the vector again
    wanted = [i / bins for i in range(bins + 1)]
    row = assembled.select(vector_to_array("features").alias("a")).agg(*[F.percentile_approx(a[i], wanted, 10_000).alias(f"q{i}") for i in range(n_features)]).first()
    return [np.unique(np.array(q or [0.0], float))[:-1][:bins - 1] for q in row]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Features by rows, as bytes: the number of edges below each value."""
    return np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)]).astype(np.uint8)


def write_blocks(assembled: DataFrame, edges: list[np.ndarray], fold: Column | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(part, nth, x, y, fold) blocks of binned rows, written to the shared folder; x is features by rows in bytes."""
    slim = assembled.select(F.spark_partition_id().alias("part"), vector_to_array("features").alias("x"), F.col("label").alias("y"),
                            (fold if fold is not None else F.lit(0)).cast("tinyint").alias("fold"))

    def run(batches):
        nth, held, n = 0, [], 0

        def block(rows):
            x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
            return pa.RecordBatch.from_arrays(
                [rows.column("part").combine_chunks()[:1], pa.array([nth], pa.int32()), pa.array([binned(x, edges).tobytes()]),
                 pa.array([rows.column("y").to_numpy().tobytes()]), pa.array([rows.column("fold").to_numpy().astype(np.int8).tobytes()])],
                names=["part", "nth", "x", "y", "fold"])

        for batch in batches:
            while n + batch.num_rows >= block_rows:
                yield block(pa.Table.from_batches([*held, batch.slice(0, block_rows - n)]))
                batch, held, n, nth = batch.slice(block_rows - n), [], 0, nth + 1
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
        if n:
            yield block(pa.Table.from_batches(held))

    blocks = slim.mapInArrow(run, "part int, nth int, x binary, y binary, fold binary")
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    # every pass reads the files as they are written, so a table of few files is spread first
    return _store(blocks.repartition(cores) if blocks.rdd.getNumPartitions() < cores else blocks, "tree-blocks")


def _store(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    write_parquet(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_totals(blocks: DataFrame) -> dict[int, tuple[int, float]]:
    """(rows, sum of the label) of each fold."""
    def run(batches):
        for b in batches:
            for y, fold in zip(b.column("y"), b.column("fold")):
                y, fold = np.frombuffer(y.as_buffer()), np.frombuffer(fold.as_buffer(), np.int8)
                there = np.unique(fold)
                yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array([int((fold == k).sum()) for k in there]),
                                                  pa.array([float(y[fold == k].sum()) for k in there])], names=["fold", "n", "y"])

    found = blocks.select("y", "fold").mapInArrow(run, "fold int, n long, y double").groupBy("fold").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    return {r.fold: (r.n, r.y) for r in found.collect()}  # a row per fold


# ---------------------------------------------------------------------------
# Splits from cells: the distinct (node, bin) of one feature with their sums
# ---------------------------------------------------------------------------

@dataclass
class Best:
    """The best split found so far of each of ``k`` nodes with sums (rows, weight, gradient)."""
    sums: np.ndarray
    growth: Growth
    gain: np.ndarray = field(init=False)
    feature: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)
    left: np.ndarray = field(init=False)

    def __post_init__(self):
        k, (_, w, g) = len(self.sums), self.sums.T
        self.own = g * g / np.maximum(w + self.growth.l2, 1e-300)
        self.gain, self.feature, self.bin, self.left = np.zeros(k), np.full(k, -1), np.zeros(k, np.int64), np.zeros((k, 3))

    def offer(self, feature: int, node: np.ndarray, bins: np.ndarray, cells: np.ndarray) -> None:
        """Cells in order of (node, bin); a node without cells gets no split."""
        p, starts = self.growth, np.flatnonzero(np.diff(node, prepend=-1))
        length = np.diff(np.append(starts, len(node)))

        def on_the_left(c):
            column = np.ascontiguousarray(cells[:, c])
            upto = np.cumsum(column)
            return upto - np.repeat(upto[starts] - column[starts], length)

        def of_node(c):
            return np.repeat(self.sums[node[starts], c], length)

        ln = on_the_left(0)
        rn = of_node(0) - ln  # none after a node's last cell
        may = (ln >= p.min_rows) & (rn >= max(p.min_rows, 1))
        if p.min_weight > 0:
            lw = on_the_left(1)
            may &= (lw >= p.min_weight) & (of_node(1) - lw >= p.min_weight)
        at = np.flatnonzero(may)
        if not len(at):
            return
        left = np.stack([ln[at], on_the_left(1)[at], on_the_left(2)[at]], 1)
        node, bins = node[at], bins[at]
        starts = np.flatnonzero(np.diff(node, prepend=-1))
        length, there = np.diff(np.append(starts, len(node))), node[starts]
        (_, lw, lg), (w, g) = left.T, (np.repeat(self.sums[there, c], length) for c in (1, 2))
        rw, rg = w - lw, g - lg
        gain = lg * lg / np.maximum(lw + p.l2, 1e-300) + rg * rg / np.maximum(rw + p.l2, 1e-300) - np.repeat(self.own[there], length)
        top = np.maximum.reduceat(gain, starts)
        better = top > self.gain[there] + 1e-12 * self.own[there]
        at = np.flatnonzero(gain == np.repeat(np.where(better, top, np.inf), length))
        at = at[np.diff(node[at], prepend=-1) > 0]
        which = node[at]
        self.gain[which], self.feature[which], self.bin[which], self.left[which] = gain[at], feature, bins[at], left[at]

    def offer_columns(self, feature: int, n: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        """Rows, weights and gradients as nodes by bins; for few nodes, where empty cells cost less than leaving them out."""
        p = self.growth
        ln, lg = np.cumsum(n, 1), np.cumsum(g, 1)
        lw = ln if w is n else np.cumsum(w, 1)
        rn, rw, rg = (s[:, None] - c for s, c in zip(self.sums.T, (ln, lw, lg)))
        may = (n > 0) & (ln >= p.min_rows) & (rn >= max(p.min_rows, 1))  # what is subtracted leaves rests in empty cells
        if p.min_weight > 0:
            may &= (lw >= p.min_weight) & (rw >= p.min_weight)
        gain = lg * lg / np.maximum(lw + p.l2, 1e-300)
        gain += rg * rg / np.maximum(rw + p.l2, 1e-300)
        gain -= self.own[:, None]
        gain[~may] = -np.inf
        at = gain.argmax(1)
        top = gain[np.arange(len(at)), at]
        which = np.flatnonzero(top > self.gain + 1e-12 * self.own)
        at = at[which]
        self.gain[which], self.feature[which], self.bin[which] = top[which], feature, at
        self.left[which] = np.stack([ln[which, at], lw[which, at], lg[which, at]], 1)

    def offer_dense(self, feature: int, hist: np.ndarray) -> None:
        """``hist``: nodes by bins by (rows, weight, gradient)."""
        at, width = np.flatnonzero(hist[:, :, 0].ravel() > 0), hist.shape[1]
        self.offer(feature, at // width, at % width, hist.reshape(-1, 3)[at])


def dense(x: np.ndarray, slot: np.ndarray, k: int, w: np.ndarray | None, g: np.ndarray, width: int = BINS) -> np.ndarray:
    """Histogram of one feature: nodes by bins by (rows, weight, gradient). ``w`` None: every row weighs 1."""
    return np.stack(columns(slot * width + x, k, w, g, width), -1)


def columns(key: np.ndarray, k: int, w: np.ndarray | None, g: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, weights and gradients of the keys (node * ``width`` + bin) as nodes by bins."""
    n = np.bincount(key, minlength=k * width).astype(float).reshape(k, width)
    return n, n if w is None else np.bincount(key, w, k * width).reshape(k, width), np.bincount(key, g, k * width).reshape(k, width)


def grow_subtree(x: np.ndarray, w: np.ndarray, g: np.ndarray, growth: Growth, features: np.ndarray, depth: int) -> dict[str, np.ndarray]:
    """All useful splits of one node's rows down to ``depth`` more levels, nodes level by level: feature, bin, left, gain, sums.

    Histograms while nodes are few, the smaller child counted and the other subtracted;
    where nodes are many and small, cells by sorting, which does not depend on the number of bins.
    Splits that best-first growth cannot reach from this node are left out.
    """
    n = x.shape[1]
    gains, above, least = np.zeros(0), np.zeros(0), np.full(1, np.inf)  # of the splits made; the least gain above each node
    out = {"feature": [np.array([-1])], "bin": [np.array([0])], "left": [np.array([-1])], "gain": [np.array([0.0])],
           "sums": [np.array([[n, w.sum(), g.sum()]], float)]}
    rows, slot, made, before, small, order = np.arange(n), np.zeros(n, np.int64), 1, None, None, None
    sums, even = out["sums"][0], bool((w == 1).all())
    width = {f: int(x[f].max()) + 1 for f in features} if n else {}
    features = [f for f in features if width.get(f, 0) > 1 and x[f].min() < width[f] - 1]  # the others cannot split
    for level in range(depth):
        k = len(sums)
        best = Best(sums, growth)
        if k <= DENSE_NODES:
            now = {}
            of = slice(None) if before is None else np.flatnonzero(small[slot])  # rows of the smaller children
            counted, at, large = rows[of], slot[of], None if before is None else np.flatnonzero(~small)
            held = {}
            step = max(CHUNK_ROWS, 8 * k * BINS)
            for a in range(0, max(len(counted), 1), step):
                some, here, base = counted[a:a + step], at[a:a + step], {}
                g_of, w_of = g[some], None if even else w[some]
                for f in features:
                    if width[f] not in base:
                        base[width[f]] = here * width[f]
                    h = columns(base[width[f]] + x[f].take(some), k, w_of, g_of, width[f])
                    if f in held:
                        for c in (0, 2) if even else (0, 1, 2):
                            held[f][c][:] += h[c]
                    else:
                        held[f] = h
            for f in features:
                h = held[f]
                if before is not None:
                    for c in (0, 2) if even else (0, 1, 2):
                        h[c][large] = before[f][c][large // 2] - h[c][large ^ 1]
                if k <= FEW_NODES:
                    best.offer_columns(f, *h)
                else:
                    at_cell = np.flatnonzero(h[0].ravel() > 0)
                    best.offer(f, at_cell // width[f], at_cell % width[f], np.stack([c.ravel()[at_cell] for c in h], 1))
                now[f] = h
        else:
            now = None
            if order is None:
                order = {f: np.argsort(x[f], kind="stable").astype(np.int32) for f in features}
                at_slot = np.full(n, -1, np.int32)
            at_slot[:] = -1
            can = sums[:, 0] >= 2 * max(growth.min_rows, 1)  # the others have no split, and their rows leave the orders for good
            at_slot[rows] = np.where(can[slot], slot, -1)
            for f in features:
                o = order[f]
                node = at_slot[o]
                of = np.flatnonzero(node >= 0)
                o, node = o[of], node[of]
                if k <= 1 << 16:
                    of = np.argsort(node.astype(np.uint16), kind="stable")
                else:
                    of = np.argsort(node, kind="stable")
                o, node = o[of], node[of]
                order[f] = o  # the children of a node keep its order of bins
                bins = x[f][o]
                first = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (bins[1:] != bins[:-1]))[:len(o)])
                if not len(first):
                    continue
                cells = np.stack([np.diff(np.append(first, len(o))).astype(float), np.add.reduceat(w[o], first), np.add.reduceat(g[o], first)], 1)
                best.offer(f, node[first], bins[first], cells)
        split = np.flatnonzero(best.feature >= 0)
        if growth.leaves is not None:
            every = np.concatenate([gains, best.gain[split]])
            split = split[_reachable(every, np.concatenate([above, least[split]]), growth.leaves)[len(gains):]]
            gains, above = np.concatenate([gains, best.gain[split]]), np.concatenate([above, least[split]])
            least = np.repeat(np.minimum(best.gain[split], least[split]), 2)
        ids = made - k + np.arange(k)
        if not len(split):
            break
        flat = {c: out[c][-1] for c in ("feature", "bin", "left", "gain")}
        child = np.full(k, -1)
        child[split] = 2 * np.arange(len(split))
        flat["feature"][split], flat["bin"][split], flat["gain"][split] = best.feature[split], best.bin[split], best.gain[split]
        flat["left"][split] = ids[-1] + 1 + child[split]
        lower = np.empty((2 * len(split), 3))
        lower[0::2], lower[1::2] = best.left[split], sums[split] - best.left[split]
        for c, empty in (("feature", -1), ("bin", 0), ("left", -1), ("gain", 0.0)):
            out[c].append(np.full(2 * len(split), empty))
        out["sums"].append(lower)
        if level + 1 == depth:
            break
        stay = child[slot] >= 0
        rows, slot = rows[stay], slot[stay]
        slot = child[slot] + (x[best.feature[slot], rows] > best.bin[slot])
        before = {f: tuple(c[split] for c in h) for f, h in now.items()} if now is not None and 2 * len(split) <= DENSE_NODES else None
        small = np.empty(2 * len(split), bool)
        small[0::2] = lower[0::2, 0] <= lower[1::2, 0]
        small[1::2] = ~small[0::2]
        made, sums = made + 2 * len(split), lower
    return {c: np.concatenate(v) for c, v in out.items()}


# ---------------------------------------------------------------------------
# Passes
# ---------------------------------------------------------------------------

@dataclass
class Growing:
    """A tree on the driver while it grows: every split that is worth making, with its gain."""
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    gain: np.ndarray
    sums: np.ndarray
    depth: np.ndarray

    @classmethod
    def root(cls) -> Growing:
        return cls(np.array([-1]), np.array([0]), np.array([-1], np.int32), np.zeros(1), np.zeros((1, 3)), np.array([0]))

    def tree(self) -> Tree:
        return Tree(self.feature, self.bin, self.left, np.zeros(len(self.left)), self.gain)

    def _add(self, feature, bin_, left, gain, sums, depth) -> None:
        for name, more in (("feature", feature), ("bin", bin_), ("left", left), ("gain", gain), ("sums", sums), ("depth", depth)):
            held = getattr(self, name)
            setattr(self, name, np.concatenate([held, np.asarray(more).astype(held.dtype)]))

    def split(self, i: int, feature: int, bin_: int, gain: float, left: np.ndarray) -> int:
        at = len(self.left)
        self.feature[i], self.bin[i], self.gain[i], self.left[i] = feature, bin_, gain, at
        self._add([-1, -1], [0, 0], [-1, -1], [0, 0], np.stack([left, self.sums[i] - left]), [self.depth[i] + 1] * 2)
        return at

    def graft(self, i: int, sub: dict[str, np.ndarray]) -> None:
        """Put a finished subtree in the place of leaf ``i``; its nodes are not looked at again before the end."""
        left = np.where(sub["left"] >= 0, sub["left"] + (len(self.left) - 1), -1)  # the subtree's node 1 comes next
        for name in ("feature", "bin", "gain", "sums"):
            getattr(self, name)[i] = sub[name][0]
        self.left[i] = left[0]
        self._add(sub["feature"][1:], sub["bin"][1:], left[1:], sub["gain"][1:], sub["sums"][1:], np.full(len(left) - 1, -1))

    def finished(self, growth: Growth, base: float) -> Tree:
        """The tree that the policy keeps of all splits: best first up to ``leaves``, or all of them."""
        value = self.sums[:, 2] / np.maximum(self.sums[:, 1] + growth.l2, 1e-300) * (1.0 if growth.rate is None else growth.rate) + base
        if growth.leaves is None:
            return Tree(self.feature.astype(np.int8), self.bin.astype(np.uint8), self.left, value, self.gain.astype(np.float32))
        keep, leaves, queue = set(), 1, [(-self.gain[0], 0)] if self.left[0] >= 0 else []
        while queue and leaves < growth.leaves:
            _, i = heapq.heappop(queue)
            keep.add(i)
            leaves += 1
            for c in (self.left[i], self.left[i] + 1):
                if self.left[c] >= 0:
                    heapq.heappush(queue, (-self.gain[c], c))
        old, left, at = [0], [], 0  # the old node of each new one, level by level
        while at < len(old):
            i = old[at]
            left.append(len(old) if i in keep else -1)
            if i in keep:
                old += [self.left[i], self.left[i] + 1]
            at += 1
        left = np.array(left, np.int32)
        return Tree(np.where(left >= 0, self.feature[old], -1).astype(np.int8), self.bin[old].astype(np.uint8), left, value[old],
                    np.where(left >= 0, self.gain[old], 0.0).astype(np.float32))


@dataclass
class Job:
    """What a pass has to know of one tree: its learner, number, features, and the splits so far."""
    learner: Learner
    column: int
    number: int
    features: np.ndarray
    base: float
    growing: Growing


def tree_features(growth: Growth, number: int, n_features: int) -> np.ndarray:
    k = max(1, int(round(growth.features * n_features)))
    return np.sort(np.random.default_rng([growth.seed, number]).choice(n_features, k, replace=False)) if k < n_features else np.arange(n_features)


def row_weights(growth: Growth, number: int, part: int, nth: int, n: int) -> np.ndarray:
    """How often each row of a block takes part in a tree: the same in every pass and every retry."""
    rng = np.random.default_rng([growth.seed, number, part, nth])
    if growth.rate is None and growth.rows == 1.0:
        return rng.poisson(1.0, n).astype(float)
    return (rng.random(n) < growth.rows).astype(float) if growth.rows < 1 else np.ones(n)


def _sample(job: Job, block: dict) -> tuple[np.ndarray | slice, np.ndarray | None, np.ndarray]:
    """(rows, weights or None where all are 1, weighted gradients) of a block that take part in the job's tree."""
    p, out = job.learner.growth, job.learner.without
    score = job.base if block["scores"] is None else block["scores"][job.column]
    if p.rate is not None and p.rows == 1.0:
        rows = slice(None) if out is None else np.flatnonzero(block["fold"] != out)
        return rows, None, (block["y"] - score)[rows]
    w = np.concatenate([row_weights(p, job.number, *piece) for piece in block["pieces"]])
    if out is not None:
        w[block["fold"] == out] = 0.0
    rows = np.flatnonzero(w > 0)
    return rows, w[rows], (block["y"] - score)[rows] * w[rows]


def _open(part: int, nth: int, x: bytes, y: bytes, fold: bytes, scores: bytes | None) -> dict:
    y = np.frombuffer(y)
    return {"pieces": [(part, nth, len(y))], "y": y, "x": np.frombuffer(x, np.uint8).reshape(-1, len(y)), "fold": np.frombuffer(fold, np.int8),
            "scores": None if scores is None else np.frombuffer(scores).reshape(-1, len(y))}


def _joined(blocks: Iterable[tuple], most: int = JOINED_ROWS) -> Iterator[dict]:
    """Blocks side by side, so that arrays are long; the pieces keep their names, which decide the samples."""
    held, n = [], 0
    for raw in blocks:
        held.append(_open(*raw))
        n += len(held[-1]["y"])
        if n >= most:
            yield _side_by_side(held)
            held, n = [], 0
    if held:
        yield _side_by_side(held)


def _side_by_side(held: list[dict]) -> dict:
    return {"pieces": [p for b in held for p in b["pieces"]], **{c: np.concatenate([b[c] for b in held], -1) for c in ("x", "y", "fold")},
            "scores": None if held[0]["scores"] is None else np.concatenate([b["scores"] for b in held], 1)}


def block_rdd(blocks: DataFrame) -> RDD:
    """The blocks as tuples (part, nth, x, y, fold, scores), spread evenly over the cores."""
    sc = blocks.sparkSession.sparkContext
    rows = blocks.select("part", "nth", "x", "y", "fold").rdd.map(lambda r: (r.part, r.nth, bytes(r.x), bytes(r.y), bytes(r.fold), None))
    parts = max(rows.getNumPartitions(), sc.defaultParallelism)
    return rows.zipWithIndex().map(lambda r: (r[1], r[0])).partitionBy(parts, lambda i: i).values()


def bin_counts(rows: RDD, n_features: int) -> np.ndarray:
    """Bins of each feature: one more than its highest bin."""
    def highest(blocks):
        yield np.max([np.frombuffer(b[2], np.uint8).reshape(n_features, -1).max(1) for b in blocks] or [np.zeros(n_features, np.uint8)], 0)

    return np.max(rows.mapPartitions(highest).collect(), 0).astype(np.int64) + 1  # a row of bytes per task


def finish_nodes(rows: RDD, jobs: list[Job], local: dict[int, list[int]], sizes: dict[tuple[int, int], float]) -> tuple[RDD, RDD]:
    """The subtrees of the nodes ``local`` (job: nodes), each grown by the one task that gets its rows; tasks get about as many rows
    each. Also the shuffled rows, for ``drop_shuffle``."""
    places = min(len(sizes), FINISHERS)
    load, place = [(0.0, i) for i in range(places)], {}
    for key in sorted(sizes, key=lambda k: (-sizes[k], k)):
        full, place[key] = heapq.heappop(load)
        heapq.heappush(load, (full + sizes[key], place[key]))

    def send(blocks):
        for block in _joined(blocks):
            for j, nodes in local.items():
                rows, w, g = _sample(jobs[j], block)
                at = jobs[j].growing.tree().leaf_of(block["x"][:, rows]) if len(jobs[j].growing.left) > 1 else None
                x = block["x"][jobs[j].features][:, rows]  # what the tree can split on
                for i in nodes:
                    r = slice(None) if at is None else np.flatnonzero(at == i)
                    if len(g[r]):
                        yield place[j, i], (j, i, block["pieces"][0][:2], np.ascontiguousarray(x[:, r]).tobytes(), None if w is None else w[r].astype(np.uint8).tobytes(), g[r].tobytes())

    def grow(sent):
        held: dict[tuple[int, int], list] = {}
        for _, (j, i, *rest) in sent:
            held.setdefault((j, i), []).append(rest)
        while held:
            (j, i), cuts = held.popitem()
            cuts.sort(key=lambda c: c[0])  # sums in an order that reruns repeat
            g = np.concatenate([np.frombuffer(c[3]) for c in cuts])
            w = np.ones(len(g)) if cuts[0][2] is None else np.concatenate([np.frombuffer(c[2], np.uint8) for c in cuts]).astype(float)
            x = np.concatenate([np.frombuffer(c[1], np.uint8).reshape(-1, len(c[3]) // 8) for c in cuts], 1)
            del cuts
            growth, of = jobs[j].learner.growth, jobs[j].features
            sub = grow_subtree(x, w, g, growth, np.arange(len(of)), growth.depth - jobs[j].growing.depth[i])
            sub["feature"] = np.where(sub["feature"] >= 0, of[sub["feature"]], -1)
            kinds = {"feature": np.int8, "bin": np.uint8, "left": np.int32, "gain": np.float32 if growth.rate is None else np.float64, "sums": np.float64}
            yield (j, i), {c: sub[c].astype(k) for c, k in kinds.items()}

    sent = rows.mapPartitions(send).partitionBy(places, lambda k: k)
    return sent.mapPartitions(grow), sent


def drop_shuffle(shuffled: RDD) -> None:
    """Delete the files of the nearest shuffle that ``shuffled`` comes from; a task that needs them again makes them anew."""
    cleaner, found, todo = shuffled.context._jsc.sc().cleaner(), [], [shuffled._jrdd.rdd()]
    while todo:
        above = todo.pop().dependencies()
        for i in range(above.size()):
            d = above.apply(i)
            if d.getClass().getSimpleName() == "ShuffleDependency":
                found.append(d.shuffleId())
            else:
                todo.append(d.rdd())
    if cleaner.isDefined():
        for shuffle in found:
            cleaner.get().doCleanupShuffle(shuffle, True)


def count_level(rows: RDD, jobs: list[Job], level: dict[int, list[tuple[int, int, int]]], parents: RDD | list, bins: np.ndarray) -> tuple[RDD | list, list]:
    """One pass of histograms. ``level`` holds per job its (node counted, its sibling or -1, the parent's place in ``parents`` or -1).

    Returns the histograms of all these nodes as a list or a persisted RDD of ((job, feature), True, hist: counted nodes and siblings in turn, best) and
    (job, feature, gain, bin, left sums, sums) of the best split that each feature gives each node.
    """
    def count(blocks):
        held = {(j, f): np.zeros((len(nodes), bins[f], 3)) for j, nodes in level.items() for f in jobs[j].features}
        for block in _joined(blocks):
            for j, nodes in level.items():
                rows, w, g = _sample(jobs[j], block)
                x = block["x"] if isinstance(rows, slice) else block["x"][:, rows]
                tree = jobs[j].growing.tree()
                if len(tree.left) > 1:
                    slots = np.full(len(tree.left), -1)
                    slots[[i for i, _, _ in nodes]] = np.arange(len(nodes))
                    slot = slots[tree.leaf_of(x)]
                    of = np.flatnonzero(slot >= 0)
                    slot, g, w = slot[of], g[of], w if w is None else w[of]
                else:
                    slot, of = np.zeros(len(g), np.int64), slice(None)
                for f in jobs[j].features:
                    held[j, f] += dense(x[f, of], slot, len(nodes), w, g, bins[f])
        for key, h in held.items():
            yield key, False, h.tobytes(), None

    def merge(sent):
        total, above = {}, {}
        for key, parent, h, _ in sent:  # one histogram per (job, feature) is held, however many tasks have counted
            h = np.frombuffer(h).reshape(-1, bins[key[1]], 3)
            if parent:
                above[key] = h
            else:
                total[key] = total[key] + h if key in total else h
        for (j, f), h in total.items():
            nodes = level[j]
            full = []
            for i, (_, sibling, p) in enumerate(nodes):
                full.append(h[i])
                if sibling >= 0:
                    full.append(above[j, f][p] - h[i])
            full = np.stack(full)
            sums = np.array([jobs[j].growing.sums[i] for c, s, _ in nodes for i in ((c, s) if s >= 0 else (c,))])
            if nodes[0][1] < 0:
                sums = full.sum(1)
            best = Best(sums, jobs[j].learner.growth)
            best.offer_dense(f, full)
            yield (j, f), True, full.tobytes(), (j, f, np.where(best.feature >= 0, best.gain, 0.0), best.bin, best.left, sums)

    counted, sc = rows.mapPartitions(count), rows.context
    size = sum(len(nodes) * 24 * int(bins[jobs[j].features].sum()) for j, nodes in level.items())
    if isinstance(parents, list) and size * rows.getNumPartitions() <= DRIVER_BYTES:
        merged = list(merge([*counted.collect(), *(r for r in parents if r[0][0] in level)]))
        return merged, sorted((r[3] for r in merged), key=lambda r: r[:2])
    if isinstance(parents, list):
        parents = sc.parallelize(parents, 1)
    place = {key: i for i, key in enumerate((j, f) for j in level for f in jobs[j].features)}
    merging = min(sc.defaultParallelism, len(place))
    sent = counted.union(parents.filter(lambda r: r[0][0] in level)).map(lambda r: (place[r[0]] % merging, r)).partitionBy(merging, lambda k: k)
    merged = sent.values().mapPartitions(merge).persist(StorageLevel.MEMORY_AND_DISK)
    return merged, sorted(merged.map(lambda r: r[3]).collect(), key=lambda r: r[:2])  # a row per learner and feature


def _reachable(gains: np.ndarray, above: np.ndarray, leaves: int | None) -> np.ndarray:
    """Which splits best-first growth can still make, given the gain of every split known and the least gain above each.

    A split is made after all those whose least gain on the way from the root is greater than its own least gain, so with
    ``leaves`` - 1 such splits it is never made."""
    least = np.minimum(gains, above)
    return np.ones(len(gains), bool) if leaves is None or len(gains) < leaves else least >= np.sort(least)[-(leaves - 1)] if leaves > 1 else least > np.inf


def grow_trees(rows: RDD, jobs: list[Job], counts: list[int], bins: np.ndarray, local_rows: int = LOCAL_ROWS) -> None:
    """Grow the jobs' trees: histogram passes while nodes are large, then one pass that finishes all others."""
    local, sizes = grow_large_nodes(rows, jobs, counts, bins, local_rows)
    if local:
        subtrees, sent = finish_nodes(rows, jobs, local, sizes)
        for (j, node), sub in subtrees.collect():
            jobs[j].growing.graft(node, sub)
        drop_shuffle(sent)


def grow_large_nodes(rows: RDD, jobs: list[Job], counts: list[int], bins: np.ndarray, local_rows: int) -> tuple[dict[int, list[int]], dict[tuple[int, int], float]]:
    """Histogram passes while nodes are large; the nodes (job: nodes) that wait to be finished, and their rows.

    Boosters finish whole trees alone: their trees are low, and a pass that counts a level moves no rows."""
    local: dict[int, list[int]] = {}
    level: dict[int, list[tuple[int, int, int]]] = {}
    least: dict[int, dict[int, float]] = {j: {0: np.inf} for j in range(len(jobs))}  # the least gain above a node
    for j, (job, n) in enumerate(zip(jobs, counts)):
        if n <= local_rows or job.learner.growth.depth == 0:
            local[j] = [0]
        else:
            level[j] = [(0, -1, -1)]
    small = [local_rows if job.learner.growth.rate is None else 0 for job in jobs]
    parents: list[RDD | list] = []
    while level:
        merged, found = [], []
        if all(isinstance(p, list) for p in parents):
            above = [r for p in parents for r in p]
        else:
            above = rows.context.union([rows.context.parallelize(p, 1) if isinstance(p, list) else p for p in parents])
        for part in _portions(level):
            m, best_of = count_level(rows, jobs, part, above, bins)
            merged.append(m)
            found += best_of
        _drop(parents)
        order = {j: [i for c, s, _ in nodes for i in ((c, s) if s >= 0 else (c,))] for j, nodes in level.items()}
        best: dict[int, list] = {j: [(0.0, -1, 0, None)] * len(order[j]) for j in level}
        for j, f, gain, cuts, left, sums in found:
            for slot, node in enumerate(order[j]):
                if jobs[j].growing.depth[node] == 0:
                    jobs[j].growing.sums[node] = sums[slot]
                if gain[slot] > best[j][slot][0]:
                    best[j][slot] = (gain[slot], f, int(cuts[slot]), left[slot])
        below: dict[int, list[tuple[int, int, int]]] = {}
        for j, nodes in order.items():
            growing, growth = jobs[j].growing, jobs[j].learner.growth
            if nodes[0] == 0 and growing.sums[0][0] <= small[j]:
                local[j] = [0]  # the tree's own sample of the rows is small
            made = np.flatnonzero(growing.left >= 0)
            slots = [s for s, node in enumerate(nodes) if best[j][s][1] >= 0 and growing.sums[node][0] > small[j] and growing.depth[node] < growth.depth]
            gains = np.concatenate([growing.gain[made], [best[j][s][0] for s in slots]])
            may = _reachable(gains, np.array([least[j][i] for i in (*made, *(nodes[s] for s in slots))]), growth.leaves)[len(made):]
            for slot in (s for s, m in zip(slots, may) if m):  # a small node waits for the last pass
                node = nodes[slot]
                gain, feature, bin_, left = best[j][slot]
                a = growing.split(node, feature, bin_, gain, left)
                least[j][a] = least[j][a + 1] = min(gain, least[j][node])
                few, many = (a, a + 1) if growing.sums[a][0] <= growing.sums[a + 1][0] else (a + 1, a)
                for child in (few, many):
                    if growing.sums[child][0] <= small[j] and growing.depth[child] < growth.depth:
                        local.setdefault(j, []).append(child)
                if growing.sums[many][0] > small[j] and growing.depth[many] < growth.depth:
                    below.setdefault(j, []).append((few, many, slot))
        level, parents = below, merged
    _drop(parents)
    return local, {(j, i): float(jobs[j].growing.sums[i][0]) if i else float(counts[j]) for j, nodes in local.items() for i in nodes}


def _drop(histograms: list[RDD | list]) -> None:
    for h in histograms:
        if isinstance(h, RDD):
            h.unpersist()


def _portions(level: dict[int, list], most: int = PASS_NODES) -> Iterator[dict[int, list]]:
    """The jobs of a level in portions of about ``most`` nodes."""
    part, n = {}, 0
    for j, nodes in level.items():
        if part and n + len(nodes) > most:
            yield part
            part, n = {}, 0
        part[j] = nodes
        n += len(nodes)
    if part:
        yield part


# ---------------------------------------------------------------------------
# Learners on few rows: tasks that have all blocks
# ---------------------------------------------------------------------------

def _used(bins: np.ndarray) -> np.ndarray:
    """The features that small learners are sent; constant ones only where there are no others."""
    return np.flatnonzero(bins > 1) if (bins > 1).any() else np.arange(len(bins))


def _to_each(rows: RDD, places: int, used: np.ndarray) -> RDD:
    """``places`` partitions that each have all blocks, with the features ``used``."""
    def send(blocks):
        for part, nth, x, y, fold, _ in blocks:
            x = np.frombuffer(x, np.uint8).reshape(-1, len(y) // 8)[used].tobytes()
            for place in range(places):
                yield place, (part, nth, x, y, fold, None)

    return rows.mapPartitions(send).partitionBy(places, lambda k: k).values()


def _table_of(sent: Iterable[tuple]) -> dict:
    """All blocks side by side, in an order that reruns repeat."""
    return _side_by_side([_open(*raw) for raw in sorted(sent, key=lambda r: r[:2])])


def _drawn(growth: Growth, number: int, bins: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The places in ``used`` of a tree's features; those that cannot split are not there."""
    features = _jobs_features(growth, number, bins)
    return np.searchsorted(used, features[np.isin(features, used)])


def _renamed(tree: Tree, used: np.ndarray) -> Tree:
    return replace(tree, feature=np.where(tree.left >= 0, used[tree.feature], -1).astype(np.int8))


def _kept_rows(learner: Learner, block: dict) -> np.ndarray:
    return np.ones(len(block["y"]), bool) if learner.without is None else block["fold"] != learner.without


def _one_tree(x: np.ndarray, w: np.ndarray, g: np.ndarray, growth: Growth, features: np.ndarray, base: float) -> Tree:
    growing = Growing.root()
    growing.graft(0, grow_subtree(x, w, g, growth, features, growth.depth))
    return growing.finished(growth, base)


def boosters_alone(rows: RDD, learners: list[Learner], bases: list[float], bins: np.ndarray) -> list[list[Tree]]:
    """The trees of each learner, all grown by one task per learner."""
    used = _used(bins)

    def fit(i, sent):
        block, learner, growth = _table_of(sent), learners[i], learners[i].growth
        mine, trees = np.flatnonzero(_kept_rows(learner, block)), []
        x, y = block["x"][:, mine], block["y"][mine]
        score = np.full(len(y), bases[i])
        for t in range(growth.trees):
            drawn = slice(None)
            if growth.rows < 1:
                drawn = np.flatnonzero(np.concatenate([row_weights(growth, t, *piece) for piece in block["pieces"]])[mine] > 0)
            g = (y - score)[drawn]
            tree = _one_tree(x[:, drawn], np.ones(len(g)), g, growth, _drawn(growth, t, bins, used), 0.0)
            score += tree.value[tree.leaf_of(x)]
            trees.append(_renamed(tree, used))
        yield i, trees

    return [trees for _, trees in sorted(_to_each(rows, len(learners), used).mapPartitionsWithIndex(fit).collect(), key=lambda r: r[0])]


def _forest_shares(learners: list[Learner], cores: int) -> list[tuple[int, range]]:
    """(learner, numbers of its trees) of each task: a forest's trees over as many tasks as there are cores."""
    return [(i, range(k, x.growth.trees, min(cores, x.growth.trees))) for i, x in enumerate(learners) for k in range(min(cores, x.growth.trees))]


def _forest_part(block: dict, learner: Learner, numbers: Iterable[int], mean: float, bins: np.ndarray, used: np.ndarray) -> Iterator[tuple[int, Tree]]:
    """(number, tree) of a share of a forest; features by their places in ``used``."""
    growth, mine = learner.growth, _kept_rows(learner, block)
    for t in numbers:
        w = np.concatenate([row_weights(growth, t, *piece) for piece in block["pieces"]])
        of = np.flatnonzero((w > 0) & mine)
        w = w[of]
        yield t, _one_tree(block["x"][:, of], w, (block["y"][of] - mean) * w, growth, _drawn(growth, t, bins, used), mean)


def forests_alone(rows: RDD, learners: list[Learner], means: list[float], bins: np.ndarray) -> tuple[RDD, RDD]:
    """(learner, number, tree) of each learner's trees, each task growing a share of one forest; and the shuffled blocks."""
    used, shares = _used(bins), _forest_shares(learners, rows.context.defaultParallelism)

    def fit(place, sent):
        i, numbers = shares[place]
        for t, tree in _forest_part(_table_of(sent), learners[i], numbers, means[i], bins, used):
            yield i, t, _renamed(tree, used)

    sent = _to_each(rows, len(shares), used)
    return sent.mapPartitionsWithIndex(fit), sent


def forest_errors_alone(rows: RDD, learners: list[Learner], means: list[float], bins: np.ndarray) -> dict[int, float]:
    """RMSE of each learner's forest on the fold that it left out. The tasks that grow the trees apply them, so none is collected."""
    used, shares = _used(bins), _forest_shares(learners, rows.context.defaultParallelism)

    def fit(place, sent):
        i, numbers = shares[place]
        block = _table_of(sent)
        out = ~_kept_rows(learners[i], block)
        x, total = block["x"][:, out], np.zeros(out.sum())
        for _, tree in _forest_part(block, learners[i], numbers, means[i], bins, used):
            total += tree.value[tree.leaf_of(x)]
        at = np.cumsum([0] + [n for _, _, n in block["pieces"]])
        ends = np.append(0, np.cumsum(out))[at]
        for (part, nth, _), a, b, c, d in zip(block["pieces"], at, at[1:], ends, ends[1:]):
            if d > c:
                yield (i, part, nth), (place, total[c:d].tobytes(), block["y"][a:b][out[a:b]].tobytes())

    def error(group):
        (i, _, _), sent = group
        sent = sorted(sent, key=lambda r: r[0])  # sums in an order that reruns repeat
        e = np.frombuffer(sent[0][2]) - sum(np.frombuffer(s[1]) for s in sent) / learners[i].growth.trees
        return i, (len(e), float(e @ e))

    errors: dict[int, list] = {}
    for i, found in _to_each(rows, len(shares), used).mapPartitionsWithIndex(fit).groupByKey(rows.getNumPartitions()).map(error).collect():  # a row per learner and block
        errors.setdefault(i, []).append(found)
    return {i: float(np.sqrt(math.fsum(s for _, s in found) / sum(n for n, _ in found))) for i, found in errors.items()}


# ---------------------------------------------------------------------------
# Forests and boosters
# ---------------------------------------------------------------------------

def _rows_of(learner: Learner, totals: dict[int, tuple[int, float]]) -> tuple[int, float]:
    """(rows, mean label) of a learner's training part: all folds less the one left out."""
    n = sum(v[0] for k, v in totals.items() if k != learner.without)
    return n, sum(v[1] for k, v in totals.items() if k != learner.without) / max(n, 1)


def _jobs_features(growth: Growth, number: int, bins: np.ndarray) -> np.ndarray:
    """The tree's features that have more than one bin, or one of the others where none has."""
    drawn = tree_features(growth, number, len(bins))
    return drawn[bins[drawn] > 1] if (bins[drawn] > 1).any() else drawn[:1]


def fit_forests(blocks: DataFrame, learners: list[Learner], n_features: int, totals: dict[int, tuple[int, float]],
                local_rows: int = LOCAL_ROWS) -> list[list[Tree]]:
    """The trees of each learner, collected."""
    return [f.collected() for f in grow_forests(blocks, learners, n_features, totals, local_rows)]


TREE_COLUMNS = {"feature": np.int8, "bin": np.uint8, "left": np.int32, "value": np.float64, "gain": np.float32}


@dataclass
class ForestFiles:
    """A forest as its tasks wrote it: folders of rows (tree, feature, bin, left, value, gain as bytes), and what the driver
    knows of it: by tree the number of nodes, of leaves, and the gain of each feature."""
    spark: SparkSession
    folders: list[str]
    nodes: np.ndarray
    leaves: np.ndarray
    gains: np.ndarray

    def collected(self) -> list[Tree]:
        rows = self.spark.read.parquet(*self.folders).orderBy("tree").collect() if self.folders else []
        return [Tree(**{c: np.frombuffer(r[c], k) for c, k in TREE_COLUMNS.items()}) for r in rows]

    def reader(self) -> Callable[[], Iterator[Tree]]:
        """A function for tasks that reads the trees one after another, always in the same order, a few in memory at a time."""
        folders = list(self.folders)

        def read():
            import pyarrow.parquet as pq
            from pyarrow import fs

            for folder in folders:
                store, path = fs.FileSystem.from_uri("file://" + folder[5:] if re.match("file:/(?!/)", folder) else folder)
                for name in sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")):
                    with store.open_input_file(name) as f:
                        file = pq.ParquetFile(f, pre_buffer=False)
                        for batch in file.iter_batches(1, columns=["feature", "bin", "left", "value"]):
                            for row in zip(*(batch.column(c) for c in range(4))):
                                feature, bin_, left, value = (np.frombuffer(v.as_buffer(), k) for v, k in zip(row, TREE_COLUMNS.values()))
                                yield Tree(feature, bin_, left, value, np.zeros(0))

        return read


def _tree_row(number: int, tree: Tree) -> tuple:
    return number, *(np.asarray(getattr(tree, c)).astype(k).tobytes() for c, k in TREE_COLUMNS.items())


def _write_trees(spark: SparkSession, rows: RDD, path: str) -> str:
    schema = "tree int, " + ", ".join(f"{c} binary" for c in TREE_COLUMNS)
    write_parquet(spark.createDataFrame(rows, schema, verifySchema=False), path)
    return path


def grow_forests(blocks: DataFrame, learners: list[Learner], n_features: int, totals: dict[int, tuple[int, float]],
                 local_rows: int = LOCAL_ROWS) -> list[ForestFiles]:
    """Each learner's forest, written by the tasks that grow it: the trees of large learners with their large nodes in the same
    passes, then finished some trees at a time, so that the rows on their way are those of a few trees; the others' by tasks that
    have all rows. The labels are taken less their mean, which every leaf adds. No tree is sent to the driver, only its large nodes."""
    spark, facts = blocks.sparkSession, [_rows_of(x, totals) for x in learners]
    rows = block_rdd(blocks).persist(StorageLevel.MEMORY_AND_DISK)
    bins = bin_counts(rows, n_features)
    drop_shuffle(rows)  # every block is persisted by now
    alone, folders = _few_rows(facts, local_rows), [[] for _ in learners]
    if alone:
        trees, sent = forests_alone(rows, [learners[i] for i in alone], [facts[i][1] for i in alone], bins)
        trees = trees.persist(StorageLevel.MEMORY_AND_DISK) if len(alone) > 1 else trees
        for at, i in enumerate(alone):
            mine = trees.filter(lambda r, at=at: r[0] == at).map(lambda r: _tree_row(*r[1:]))
            folders[i].append(_write_trees(spark, mine, shared_path(spark, "forest")))
        trees.unpersist()
        drop_shuffle(sent)
    jobs, counts = [], []
    for i, learner in enumerate(learners):
        if i not in alone:
            n, mean = facts[i]
            jobs += [Job(learner, i, t, _jobs_features(learner.growth, t, bins), mean, Growing.root()) for t in range(learner.growth.trees)]
            counts += [n] * learner.growth.trees
    local, sizes = grow_large_nodes(rows, jobs, counts, bins, local_rows) if jobs else ({}, {})
    for some in _few_trees(jobs, local, NODES_A_CORE * rows.context.defaultParallelism):
        of = [jobs[j] for j in some]
        here = {a: local[j] for a, j in enumerate(some) if j in local}
        path, shuffled = shared_path(spark, "forest"), []
        places, finish = len(of), _assembler(of)  # a tree is a file, and a task holds one
        if here:
            subtrees, sent = finish_nodes(rows, of, here, {(a, node): sizes[some[a], node] for a, nodes in here.items() for node in nodes})
            grouped = subtrees.map(lambda r: (r[0][0], (r[0][1], r[1]))).union(rows.context.parallelize([(a, None) for a in range(len(of))], 1))
            shuffled.append(sent)
        else:
            grouped = rows.context.parallelize([(a, None) for a in range(len(of))], places)
        grouped = grouped.partitionBy(places, lambda a: a)
        _write_trees(spark, grouped.mapPartitions(finish), path)
        for x in [grouped, *shuffled]:
            drop_shuffle(x)
        (column,) = {job.column for job in of}
        folders[column].append(path)
        for job in of:
            job.growing = None
    rows.unpersist()
    return [_known(spark, f, n_features) for f in folders]


def _few_trees(jobs: list[Job], local: dict[int, list[int]], nodes: int) -> Iterator[list[int]]:
    """The jobs, those of one learner as many at a time as have about ``nodes`` nodes to finish."""
    some, n = [], 0
    for j, job in enumerate(jobs):
        if some and (n >= nodes or jobs[some[-1]].column != job.column):
            yield some
            some, n = [], 0
        some.append(j)
        n += len(local.get(j, ()))
    if some:
        yield some


def _assembler(jobs: list[Job]) -> Callable[[Iterable], Iterator[tuple]]:
    """What a task does with (job, None) and (job, (node, subtree)): the rows of the finished trees of its jobs."""
    def run(sent):
        subtrees: dict[int, list] = {}
        for a, found in sent:
            subtrees.setdefault(a, []).extend([] if found is None else [found])
        for a in sorted(subtrees):
            growing = jobs[a].growing
            for node, sub in sorted(subtrees[a], key=lambda r: r[0]):  # in an order that reruns repeat
                growing.graft(node, sub)
            yield _tree_row(jobs[a].number, growing.finished(jobs[a].learner.growth, jobs[a].base))

    return run


def _known(spark: SparkSession, folders: list[str], n_features: int) -> ForestFiles:
    """The files with the sizes and gains of their trees."""
    def run(batches):
        for b in batches:
            for tree, feature, left, gain in zip(*(b.column(c) for c in range(4))):
                left, feature = np.frombuffer(left.as_buffer(), np.int32), np.frombuffer(feature.as_buffer(), np.int8)
                inner = left >= 0
                gains = np.bincount(feature[inner], np.frombuffer(gain.as_buffer(), np.float32)[inner], n_features)
                yield pa.RecordBatch.from_arrays([pa.array([tree.as_py()], pa.int32()), pa.array([len(left)]), pa.array([int((~inner).sum())]), pa.array([gains.tobytes()])],
                                                 names=["tree", "nodes", "leaves", "gains"])

    if not folders:
        return ForestFiles(spark, [], np.zeros(0, int), np.zeros(0, int), np.zeros((0, n_features)))
    found = spark.read.parquet(*folders).select("tree", "feature", "left", "gain").mapInArrow(run, "tree int, nodes long, leaves long, gains binary")
    found = sorted(found.collect(), key=lambda r: r.tree)  # a row per tree
    return ForestFiles(spark, folders, np.array([r.nodes for r in found]), np.array([r.leaves for r in found]),
                       np.array([np.frombuffer(r.gains) for r in found]).reshape(-1, n_features))


def _few_rows(facts: list[tuple[int, float]], local_rows: int) -> list[int]:
    return [i for i, (n, _) in enumerate(facts) if 0 < n <= local_rows]


def forest_errors(blocks: DataFrame, learners: list[Learner], n_features: int, totals: dict[int, tuple[int, float]],
                  local_rows: int = LOCAL_ROWS) -> dict[int, float]:
    """RMSE of each learner's forest on the fold that it left out; learners without such rows are not there. The driver holds
    none of them."""
    learners_of = {i: x for i, x in enumerate(learners) if totals.get(x.without, (0, 0.0))[0]}
    facts = [_rows_of(x, totals) for x in learners]
    alone, errors = [i for i in _few_rows(facts, local_rows) if i in learners_of], {}
    if alone:
        rows = block_rdd(blocks).persist(StorageLevel.MEMORY_AND_DISK)
        found = forest_errors_alone(rows, [learners[i] for i in alone], [facts[i][1] for i in alone], bin_counts(rows, n_features))
        errors = {alone[i]: e for i, e in found.items()}
        rows.unpersist()
    for i, learner in learners_of.items():
        if i not in alone:
            (files,) = grow_forests(blocks, [learner], n_features, totals, local_rows)
            errors[i] = forest_error(blocks, learner, files.reader(), n_features)
    return errors


def forest_error(blocks: DataFrame, learner: Learner, trees: list[Tree] | Callable[[], Iterator[Tree]], n_features: int) -> float | None:
    """RMSE of a forest on the fold that it left out; ``trees`` may be a function that reads them."""
    def run(batches):
        raw = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("part", "nth", "x", "y", "fold")), [None] * b.num_rows))
        for block in _joined(raw, FOREST_ROWS):
            held_out = np.flatnonzero(block["fold"] == learner.without)
            x, total, n = block["x"][:, held_out], np.zeros(len(held_out)), 0
            for t in trees() if callable(trees) else trees:
                total += t.value[t.leaf_of(x)]
                n += 1
            e = block["y"][held_out] - total / max(n, 1)
            yield pa.RecordBatch.from_arrays([pa.array([len(e)]), pa.array([float(e @ e)])], names=["n", "sse"])

    r = blocks.mapInArrow(run, "n long, sse double").agg(F.sum("n").alias("n"), F.sum("sse").alias("sse")).first()
    return float(np.sqrt(r.sse / r.n)) if r.n else None


def with_scores(rows: RDD, bases: list[float], trees: list[list[Tree]], left_out_of: list[Learner] | None = None) -> RDD:
    """The blocks with each learner's score of each row brought up to date, or of the rows that the learner left out."""
    def add(raw):
        block = _open(*raw)
        scores = np.repeat(np.array(bases)[:, None], len(block["y"]), 1) if block["scores"] is None else block["scores"].copy()
        for i, (s, more) in enumerate(zip(scores, trees)):
            of, x = slice(None), block["x"]
            if more and left_out_of is not None:
                of = np.flatnonzero(~_kept_rows(left_out_of[i], block))
                x = x[:, of]
            for tree in more:
                s[of] += tree.value[tree.leaf_of(x)]
        return *raw[:5], scores.tobytes()

    return rows.map(add)


def fit_boosters(blocks: DataFrame, learners: list[Learner], n_features: int, totals: dict[int, tuple[int, float]],
                 local_rows: int = LOCAL_ROWS) -> tuple[list[tuple[float, list[Tree]]], RDD]:
    """((base, trees) of each learner, the blocks with their final scores): all large learners advance tree by tree in the same
    passes, each of the others is fitted by one task; of these the scores are those of the rows that they left out."""
    sc, facts = blocks.sparkSession.sparkContext, [_rows_of(x, totals) for x in learners]
    bases = [mean for _, mean in facts]
    trees: list[list[Tree]] = [[] for _ in learners]
    kept = [with_scores(block_rdd(blocks), bases, [[] for _ in learners]).persist(StorageLevel.MEMORY_AND_DISK)]
    bins = bin_counts(kept[0], n_features)
    alone = _few_rows(facts, local_rows)
    rounds = max((x.growth.trees for i, x in enumerate(learners) if i not in alone), default=0)
    for t in range(rounds):
        on = [i for i, x in enumerate(learners) if t < x.growth.trees and i not in alone]
        jobs = [Job(learners[i], i, t, _jobs_features(learners[i].growth, t, bins), bases[i], Growing.root()) for i in on]
        grow_trees(kept[-1], jobs, [facts[i][0] for i in on], bins, local_rows)
        while len(kept) > 1:  # the newest has been computed by now
            kept.pop(0).unpersist()
        for i, job in zip(on, jobs):
            trees[i].append(job.growing.finished(job.learner.growth, 0.0))
        scored = with_scores(kept[-1], bases, [x[t:t + 1] for x in trees])
        if (t + 1) % REWRITE == 0 or t + 1 == rounds:
            path = shared_path(blocks.sparkSession, "tree-scores")
            scored.saveAsPickleFile(path, 1)
            for old in kept:
                old.unpersist()
            kept, scored = [], sc.pickleFile(path)
        if t + 1 < rounds or alone:
            scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
        kept.append(scored)
    if alone:
        for i, found in zip(alone, boosters_alone(kept[-1], [learners[i] for i in alone], [bases[i] for i in alone], bins)):
            trees[i] = found
        kept.append(with_scores(kept[-1], bases, [x if i in alone else [] for i, x in enumerate(trees)], learners))
        for old in kept[:-1]:
            old.unpersist()
    return list(zip(bases, trees)), kept[-1]


def held_out_errors(scored: RDD, learners: list[Learner], n_features: int) -> dict[int, float]:
    """RMSE of each learner on the fold that it left out, from the final scores."""
    def run(blocks):
        n, sse = np.zeros(len(learners), np.int64), np.zeros(len(learners))
        for raw in blocks:
            block = _open(*raw)
            for i, x in enumerate(learners):
                e = (block["y"] - block["scores"][i])[block["fold"] == x.without]
                n[i] += len(e)
                sse[i] += e @ e
        yield n, sse

    n, sse = scored.mapPartitions(run).reduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
    return {i: float(np.sqrt(sse[i] / n[i])) for i in range(len(learners)) if n[i]}


# ---------------------------------------------------------------------------
# The fitted model
# ---------------------------------------------------------------------------

def forest_model(files: ForestFiles, growth: Growth, edges: list[np.ndarray]) -> TreeModel | StoredForest:
    """A forest as a model: with its trees in memory up to ``DRIVER_NODES`` nodes, else in the files."""
    if files.nodes.sum() <= DRIVER_NODES:
        return TreeModel.of(files.collected(), 0.0, growth, edges)
    return StoredForest(files, growth, edges)


class StoredForest:
    """A forest whose trees stay in the files that the tasks wrote: scores columns and tables as ``TreeModel`` does. A task sends
    ``FOREST_ROWS`` rows at a time through all trees, of which it holds a few."""

    def __init__(self, files: ForestFiles, growth: Growth, edges: list[np.ndarray]):
        self.files, self.edges = files, edges
        total = files.gains.sum(1, keepdims=True)
        shares = (files.gains / np.where(total > 0, total, 1.0)).sum(0)
        self.importances = shares / max(shares.sum(), 1e-300)
        self.settings = {k: v for k, v in vars(growth).items()} | {"fitted_trees": len(files.nodes), "fitted_leaves": int(files.leaves.max(initial=0))}

    def score(self, features: list[Column]) -> Column:
        edges, read, at_once, trees = self.edges, self.files.reader(), FOREST_ROWS, max(len(self.files.nodes), 1)

        def through(held):
            x = np.concatenate(held, 1)
            total = np.zeros(x.shape[1])
            for tree in read():
                total += tree.value[tree.leaf_of(x)]
            return pd.Series(total / trees)

        def predicted(batches):
            held, n = [], 0
            for rows in batches:
                x = rows.to_numpy(float)
                held.append(np.where(np.isnan(x.T), 0, binned(x, edges)).astype(np.uint8))  # a missing value is above no cut
                n += len(x)
                if n >= at_once:
                    yield through(held)
                    held, n = [], 0
            if held:
                yield through(held)

        udf = F.pandas_udf(predicted, "double", functionType=PandasUDFType.SCALAR_ITER)
        return udf(F.struct(*[c.cast("double").alias(f"f{i}") for i, c in enumerate(features)]))

    def transform(self, assembled: DataFrame) -> DataFrame:
        """``prediction`` beside the columns of an assembled table."""
        a = vector_to_array(F.col("features"))
        return assembled.withColumn("prediction", self.score([a[i] for i in range(len(self.importances))]))

    def save(self, spark: SparkSession, path: str) -> None:
        """The table that ``TreeModel`` saves and loads, written by tasks."""
        upper = np.full((len(self.edges), BINS), np.inf)
        for f, e in enumerate(self.edges):
            upper[f, :len(e)] = e

        def run(batches):
            for b in batches:
                for tree, *held in zip(*(b.column(c) for c in range(5))):
                    feature, bin_, left, value = (np.frombuffer(v.as_buffer(), k) for v, k in zip(held, TREE_COLUMNS.values()))
                    threshold = np.where(left >= 0, upper[feature, bin_], np.inf)
                    yield pa.RecordBatch.from_arrays([pa.array([tree.as_py()], pa.int32()), *(pa.array([c], pa.list_(k)) for c, k in (
                        (feature.astype(np.int32), pa.int32()), (threshold, pa.float64()), (left, pa.int32()), (value, pa.float64())))], names=names)

        names = ["tree", "feature", "threshold", "left", "value"]
        trees = spark.read.parquet(*self.files.folders).select("tree", "feature", "bin", "left", "value")
        trees.mapInArrow(run, "tree int, feature array<int>, threshold array<double>, left array<int>, value array<double>").write.mode("overwrite").parquet(f"{path}/trees")
        meta = [(0.0, True, self.importances.tolist(), {k: str(v) for k, v in self.settings.items()})]
        spark.createDataFrame(meta, MODEL_SCHEMA).write.mode("overwrite").parquet(f"{path}/model")


MODEL_SCHEMA = "base double, mean boolean, importances array<double>, settings map<string,string>"


class TreeModel:
    """Fitted trees on raw feature values: scores arrays or columns, is saved and loaded as a table of one row per tree."""

    def __init__(self, thresholds: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], base: float, mean: bool, importances: np.ndarray, settings: dict):
        self.trees, self.base, self.mean, self.importances, self.settings = thresholds, base, mean, importances, settings
        self._masks = None

    @classmethod
    def of(cls, trees: list[Tree], base: float, growth: Growth, edges: list[np.ndarray]) -> TreeModel:
        raw, importances = [], np.zeros(len(edges))
        upper = np.full((len(edges), BINS), np.inf)
        for f, e in enumerate(edges):
            upper[f, :len(e)] = e
        for t in trees:
            inner = t.left >= 0
            raw.append((t.feature.astype(np.int32), np.where(inner, upper[t.feature, t.bin], np.inf), t.left, t.value))
            gains = np.bincount(t.feature[inner], t.gain[inner], len(edges))
            # a forest's importances are the mean of its trees' shares, a booster's the share of all gains
            importances += gains / gains.sum() if growth.rate is None and gains.sum() > 0 else gains
        settings = {k: v for k, v in vars(growth).items()} | {"fitted_trees": len(trees), "fitted_leaves": max((int((t.left < 0).sum()) for t in trees), default=0)}
        return cls(raw, 0.0 if growth.rate is None else base, growth.rate is None, importances / max(importances.sum(), 1e-300), settings)

    def predict_array(self, x: np.ndarray) -> np.ndarray:
        """Predictions of rows by features."""
        if max((len(left) for _, _, left, _ in self.trees), default=0) < 2 * LEAF_BITS:
            return self._predict_by_masks(x)
        return self._predict_by_steps(x)

    def _predict_by_masks(self, x: np.ndarray, at_once: int = 2048) -> np.ndarray:
        """For trees of at most 64 leaves: a row's place among a feature's cuts gives the leaves that the tree's nodes on this
        feature leave open, and the first leaf open for all features is the row's (QuickScorer). The same sums in the same order."""
        if self._masks is None:
            self._masks = self._leaf_masks()
        cuts, trees = self._masks
        total = np.zeros(len(x))
        for at in range(0, len(x), at_once):
            part, sums = x[at:at + at_once], total[at:at + at_once]
            place = {f: np.where(np.isnan(part[:, f]), 0, np.searchsorted(c, part[:, f], "left")) for f, c in cuts.items()}
            open_, more = np.empty(len(part), np.uint64), np.empty(len(part), np.uint64)
            for masks, value in trees:
                if not masks:
                    sums += value[0]
                    continue
                open_[:] = ~np.uint64(0)
                for f, mask in masks:
                    np.take(mask, place[f], out=more, mode="clip")
                    open_ &= more
                np.bitwise_and(open_, np.negative(open_, out=more), out=open_)
                open_ *= DE_BRUIJN
                open_ >>= np.uint64(58)
                sums += value[open_.view(np.int64)]
        return total / max(len(self.trees), 1) if self.mean else total + self.base

    def _leaf_masks(self) -> tuple[dict[int, np.ndarray], list]:
        """The cuts of each feature, and for each tree its (feature, open leaves by place among the cuts) and leaf values by de Bruijn index."""
        inner = [(feature[left >= 0], cut[left >= 0]) for feature, cut, left, _ in self.trees]
        every = {int(f): np.unique(np.concatenate([c[g == f] for g, c in inner])) for f in {int(f) for g, _ in inner for f in g}}
        trees = []
        for feature, cut, left, value in self.trees:
            under, leaves, stack = {}, [], [(0, False)]
            while stack:  # leaves from left to right, and for each node how many there were before it and are after it
                i, done = stack.pop()
                if done:
                    under[i] = (under[i], len(leaves))
                    continue
                under[i] = len(leaves)
                stack.append((i, True))
                if left[i] < 0:
                    leaves.append(i)
                else:
                    stack += [(left[i] + 1, False), (left[i], False)]
            masks = {}
            for i in np.flatnonzero(left >= 0):
                f = int(feature[i])
                first, end = under[left[i]]
                mask = masks.setdefault(f, np.full(len(every[f]) + 1, ~np.uint64(0)))
                mask[np.searchsorted(every[f], cut[i]) + 1:] &= np.uint64(~(((1 << (end - first)) - 1) << first) & (1 << 64) - 1)
            of = np.full(64, value[leaves[0]])
            of[[(int(DE_BRUIJN) << k & (1 << 64) - 1) >> 58 for k in range(len(leaves))]] = value[leaves]
            trees.append((list(masks.items()), of))
        return every, trees

    def _predict_by_steps(self, x: np.ndarray) -> np.ndarray:
        total, n = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, left, value in self.trees:
            at, todo = np.zeros(len(x), np.int32), n
            while len(todo):
                todo = todo[left[at[todo]] >= 0]
                here = at[todo]
                at[todo] = left[here] + (x[todo, feature[here]] > cut[here])
            total += value[at]
        return total / max(len(self.trees), 1) if self.mean else total + self.base

    def score(self, features: list[Column]) -> Column:
        """The prediction as a column: Arrow batches to the trees, which travel with the function (Spark broadcasts large ones)."""
        @F.pandas_udf("double")
        def predicted(rows: pd.DataFrame) -> pd.Series:
            return pd.Series(self.predict_array(rows.to_numpy(float)))

        return predicted(F.struct(*[c.cast("double").alias(f"f{i}") for i, c in enumerate(features)]))

    def transform(self, assembled: DataFrame) -> DataFrame:
        """``prediction`` beside the columns of an assembled table."""
        a = vector_to_array(F.col("features"))
        return assembled.withColumn("prediction", self.score([a[i] for i in range(len(self.importances))]))

    def save(self, spark: SparkSession, path: str) -> None:
        columns = [pa.array([c.tolist() for c in column], pa.list_(kind)) for column, kind in
                   zip(zip(*self.trees), (pa.int32(), pa.float64(), pa.int32(), pa.float64()))]
        trees = pa.table([pa.array(range(len(self.trees)), pa.int32()), *columns], names=["tree", "feature", "threshold", "left", "value"])
        spark.createDataFrame(trees).write.mode("overwrite").parquet(f"{path}/trees")
        meta = [(self.base, self.mean, self.importances.tolist(), {k: str(v) for k, v in self.settings.items()})]
        spark.createDataFrame(meta, MODEL_SCHEMA).write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeModel:
        meta = spark.read.parquet(f"{path}/model").first()
        rows = spark.read.parquet(f"{path}/trees").orderBy("tree").collect()  # a row per tree
        trees = [(np.array(r.feature, np.int32), np.array(r.threshold), np.array(r.left, np.int32), np.array(r.value)) for r in rows]
        return cls(trees, meta.base, meta.mean, np.array(meta.importances), dict(meta.settings))
