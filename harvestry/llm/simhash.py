"""SimHash near-duplicates by the generalised pigeonhole principle.

1. A 64-bit SimHash per text; equal fingerprints fold into one class first, so a
   group of copies of any size costs one row from here on.
2. Bits that go together are put into the same partition (greedy on the 64 x 64
   correlation matrix of all classes). If two fingerprints differ in at most T
   bits and thresholds t_i >= -1 satisfy sum(t_i + 1) = T + 1, some partition
   differs in at most t_i bits. Each fingerprint picks its own thresholds by
   dynamic programming on estimated candidate counts: distance histograms of
   8-bit blocks, convolved inside a partition, plus a price for every probe.
   A threshold of -1 skips a partition.
3. Every class is indexed under its value in each partition and probes the
   values within its thresholds. Rows meet in buckets (partition, value); a
   bucket over ``BLOCK`` rows is split into blocks and all pairs of blocks are
   compared in tasks of their own. Candidates are verified on the whole 64 bits
   in numpy and never leave the task: a batch emits only a spanning forest of
   its links, at most one row per fingerprint.
4. Components of the forest; members get the smallest id of their component.

To the driver go only tables of fixed size: the 64 x 64 matrix and 256 counts
for each of at most 16 blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.llm.common import schema_of, store
from harvestry.llm.components import components

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: Price of one probe (a shuffled row) in verified candidates (a XOR and a bit count).
PROBE_PRICE = 200
BLOCK = 8192
CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash over shingles of ``size`` words; 0 without words."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if not parts:
        return 0
    joined = b" ".join(parts)
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    step = min(size, len(parts))
    n, ones, digest = len(parts) - step + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        end = min(n, at + CHUNK)
        h = [digest(joined[a:b - 1], seed) for a, b in zip(starts[at:end].tolist(), starts[at + step:end + step].tolist())]
        ones += np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE, seed: int = SEED, carry: tuple = ()) -> DataFrame:
    """(id, carried columns, fp); fp holds the 64 bits as a signed long."""
    slim = docs.select(F.col(id_col).alias("id"), *carry, F.col(text_col).alias("text"))
    schema = schema_of(slim.drop("text").withColumn("fp", F.lit(0).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), size, seed) for t in b.column("text")], np.uint64).view(np.int64)
            cols = [b.column(c) for c in b.schema.names if c != "text"] + [pa.array(fps)]
            yield pa.RecordBatch.from_arrays(cols, names=[c for c in b.schema.names if c != "text"] + ["fp"])

    return slim.mapInArrow(run, schema)


def bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_correlation(classes: DataFrame) -> tuple[int, np.ndarray]:
    """(number of classes, absolute correlation of the 64 bits), over all classes."""
    def count(batches):
        both, n = np.zeros((64, 64)), 0
        for b in batches:
            x = bits_of(b.column("fp").to_numpy().astype(np.int64)).astype(np.float32)
            both, n = both + x.T @ x, n + len(x)
        rows = np.column_stack([both, np.full(64, n)]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(64))] + [pa.array(c) for c in rows.T],
                                         names=["i"] + [f"c{j}" for j in range(65)])

    schema = "i long, " + ", ".join(f"c{j} long" for j in range(65))
    sums = (classes.select("fp").mapInArrow(count, schema).groupBy("i")
            .agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(65)]).orderBy("i").collect())
    if not sums:
        return 0, np.zeros((64, 64))
    table = np.array([list(r)[1:] for r in sums], float)
    n = table[0, 64]
    if n == 0:
        return 0, np.zeros((64, 64))
    both = table[:, :64] / n
    p = np.diag(both)
    scale = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    return int(n), np.abs(np.divide(both - np.outer(p, p), scale, out=np.zeros_like(both), where=scale > 1e-12))


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """``m`` partitions of nearly equal width; each grows by the bit most correlated with those it has."""
    free, groups = set(range(64)), []
    for i in range(m):
        width = 64 // m + (i < 64 % m)
        own = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.remove(own[0])
        while len(own) < width:
            own.append(max(sorted(free), key=lambda b: corr[b, own].sum()))
            free.remove(own[-1])
        groups.append(sorted(own))
    return groups


def ball(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(radius + 1)) if radius >= 0 else 0


def choose_m(n: int, max_bits: int) -> int:
    """Number of partitions with the least cost for ``n`` uniform fingerprints."""
    def cost(m):
        units = max_bits + 1
        each = [units // m + (i < units % m) for i in range(m)]
        return sum(PROBE_PRICE * ball(64 // m, e - 1) + n * ball(64 // m, e - 1) / 2.0 ** (64 // m) for e in each)
    return min(range(2, max_bits + 2), key=cost)


def gather(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.int64(b)) & np.int64(1)) << np.int64(k)
    return out


def blocks_of(groups: list[list[int]]) -> list[tuple[int, list[int]]]:
    return [(g, bits[k:k + 8]) for g, bits in enumerate(groups) for k in range(0, len(bits), 8)]


def block_histograms(classes: DataFrame, groups: list[list[int]]) -> np.ndarray:
    blocks = blocks_of(groups)

    def count(batches):
        hist = np.zeros((len(blocks), 256), np.int64)
        for b in batches:
            fps = b.column("fp").to_numpy().astype(np.int64)
            for k, (_, bits) in enumerate(blocks):
                hist[k] += np.bincount(gather(fps, bits), minlength=256)
        k, v = np.nonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64) * 256 + v), pa.array(hist[k, v])], names=["cell", "n"])

    out = np.zeros(len(blocks) * 256)
    for r in classes.select("fp").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(len(blocks), 256)


def distance_tables(hist: np.ndarray, max_bits: int) -> np.ndarray:
    """[block, value, d]: share of the classes whose block differs from ``value`` in exactly d bits."""
    values = np.arange(256)
    d = np.bitwise_count((values[:, None] ^ values[None, :]).astype(np.uint8))
    total = np.maximum(hist.sum(1, keepdims=True), 1)
    return np.stack([(hist / total) @ (d == k) for k in range(max_bits + 1)], axis=2)


def allocate(fps: np.ndarray, groups: list[list[int]], tables: np.ndarray, n: int, max_bits: int) -> np.ndarray:
    """Thresholds [fingerprint, partition] (>= -1) by dynamic programming over partitions and units t_i + 1."""
    units, m = max_bits + 1, len(groups)
    cost = np.zeros((len(fps), m, units + 1))
    blocks = blocks_of(groups)
    for g, bits in enumerate(groups):
        near = None
        for k, (owner, sub) in enumerate(blocks):
            if owner == g:
                own = tables[k][gather(fps, sub)]
                near = own if near is None else np.stack(
                    [sum(near[:, a] * own[:, d - a] for a in range(d + 1)) for d in range(max_bits + 1)], axis=1)
        candidates = n * np.cumsum(near, axis=1)
        for e in range(1, units + 1):
            cost[:, g, e] = PROBE_PRICE * ball(len(bits), e - 1) + candidates[:, e - 1]
    best = np.full((len(fps), units + 1), np.inf)
    best[:, 0] = 0
    choice = np.zeros((m, len(fps), units + 1), np.int64)
    for g in range(m):
        options = np.stack([np.stack([best[:, s - e] + cost[:, g, e] if e <= s else np.full(len(fps), np.inf)
                                      for e in range(units + 1)]) for s in range(units + 1)])
        choice[g] = options.argmin(1).T
        best = options.min(1).T
    left, out = np.full(len(fps), units), np.zeros((len(fps), m), np.int64)
    rows = np.arange(len(fps))
    for g in range(m - 1, -1, -1):
        out[:, g] = choice[g][rows, left]
        left = left - out[:, g]
    return out - 1


def probe_rows(classes: DataFrame, groups: list[list[int]], tables: np.ndarray, n: int, max_bits: int) -> DataFrame:
    """(key, fp, role): role 1 indexed under the key, 2 probing it, 3 both."""
    masks = {w: [np.array([sum(1 << b for b in c) for c in combinations(range(w), k)], np.int64) for k in range(max_bits + 1)]
             for w in {len(g) for g in groups} if ball(w, max_bits) <= 100_000}

    def masks_for(w, k):
        return masks[w][k] if w in masks else np.array([sum(1 << b for b in c) for c in combinations(range(w), k)], np.int64)

    def run(batches):
        for b in batches:
            every = b.column("fp").to_numpy().astype(np.int64)
            for at in range(0, len(every), 4096):
                fps = every[at:at + 4096]
                thresholds = allocate(fps, groups, tables, n, max_bits)
                for g, bits in enumerate(groups):
                    value, tag = gather(fps, bits), np.int64(g) << np.int64(40)
                    t = thresholds[:, g]
                    yield _rows(tag | value, fps, np.where(t >= 0, 3, 1))
                    for k in range(1, max_bits + 1):
                        who = t >= k
                        if who.any():
                            mask = masks_for(len(bits), k)
                            yield _rows((tag | (value[who][:, None] ^ mask[None, :])).ravel(), np.repeat(fps[who], len(mask)),
                                        np.full(who.sum() * len(mask), 2))

    return classes.select("fp").mapInArrow(run, "key long, fp long, role int")


def _rows(key, fp, role):
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), pa.array(role.astype(np.int32))], names=["key", "fp", "role"])


def in_blocks(probes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add (a, b): the block of index rows and of probing rows; buckets over ``block`` rows meet block by block."""
    zero = F.lit(0).cast("long")
    large = store(probes.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > block)
                  .select("key", F.ceil(F.col("rows") / block).cast("long").alias("k")), "simhash-large")
    split = probes.join(large, "key", "left").withColumn("k", F.coalesce("k", F.lit(1).cast("long")))
    own, every = F.pmod(F.xxhash64("fp"), F.col("k")), F.sequence(zero, F.col("k") - 1)
    index = F.transform(every, lambda x: F.struct(own.alias("a"), x.alias("b"), F.lit(1).alias("role")))
    probe = F.transform(every, lambda x: F.struct(x.alias("a"), own.alias("b"), F.lit(2).alias("role")))
    one = F.array(F.struct(zero.alias("a"), zero.alias("b"), F.col("role").alias("role")))
    cells = F.when(F.col("k") == 1, one).otherwise(F.concat(
        F.when(F.col("role") != 2, index).otherwise(F.slice(index, 1, 0)), F.when(F.col("role") != 1, probe).otherwise(F.slice(probe, 1, 0))))
    return split.select("key", "fp", F.explode(cells).alias("c")).select("key", "c.a", "c.b", "fp", "c.role")


def matches(run: np.ndarray, fps: np.ndarray, role: np.ndarray, max_bits: int, most: int = 1 << 21):
    """Linked pairs (u, v) of probing and indexed rows with the same run number; runs are sorted."""
    index, probe = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    first = np.searchsorted(run[index], run[probe], "left")
    count = np.searchsorted(run[index], run[probe], "right") - first
    total = np.concatenate([[0], np.cumsum(count)])
    at, us, vs = 0, [], []
    while at < len(probe):
        end = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        c = count[at:end]
        p = np.repeat(probe[at:end], c)
        i = index[np.repeat(first[at:end], c) + np.arange(c.sum()) - np.repeat(total[at:end] - total[at], c)]
        x = fps[p] ^ fps[i]
        hit = (x != 0) & (np.bitwise_count(x.view(np.uint64)) <= max_bits)
        us.append(fps[p[hit]])
        vs.append(fps[i[hit]])
        at = end
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node that is not its component's smallest."""
    nodes, inv = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inv[:len(u)], inv[len(u):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return nodes[label != np.arange(len(nodes))], nodes[label[label != np.arange(len(nodes))]]


def verified_forest(cells: DataFrame, max_bits: int) -> DataFrame:
    """(u, v): a spanning forest of the links found in each task's buckets."""
    def run(batches):
        held = None
        for b in batches:
            new = [b.column(c).to_numpy().astype(np.int64) for c in ("key", "a", "b", "fp", "role")]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            edge = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0) | (np.diff(held[2]) != 0)) + 1
            if len(edge):  # the last bucket may go on in the next batch
                done, held = [x[:edge[-1]] for x in held], [x[edge[-1]:] for x in held]
                yield from links(done)
        if held is not None:
            yield from links(held)

    def links(rows):
        key, a, b, fps, role = rows
        if len(key):
            new = (np.diff(key) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)
            u, v = forest(*matches(np.concatenate([[0], np.cumsum(new)]), fps, role, max_bits))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    placed = cells.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return placed.mapInArrow(run, "u long, v long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, max_bits: int = MAX_BITS,
                seed: int = SEED, carry: tuple = (), block: int = BLOCK) -> DataFrame:
    """One row per input row: id, carried columns, fp and root (the group's smallest fp, long), component (smallest id reachable).

    Fingerprints are linked at ``max_bits`` or fewer differing bits, directly or
    through others; equal fingerprints always are. A null or empty text has
    fingerprint zero and is linked like any other. Null ids are never the
    smallest unless a component has no other.
    """
    rows = store(fingerprints(docs, id_col, text_col, size, seed, carry), "simhash-rows")
    classes = store(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    n, corr = bit_correlation(classes)
    groups = group_bits(corr, choose_m(n, max_bits))
    tables = distance_tables(block_histograms(classes, groups), max_bits)
    probes = store(probe_rows(classes, groups, tables, n, max_bits), "simhash-probes")
    roots = components(verified_forest(in_blocks(probes, block), max_bits)).withColumnRenamed("node", "fp")
    rooted = store(classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_fp = store(rooted.join(least, "root").select("fp", "root", "component"), "simhash-components")
    return rows.join(by_fp, "fp").select("id", *carry, "fp", "root", "component")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                  max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest id, then the first row in its file."""
    from harvestry.llm.exact_dedup import located

    docs = located(docs)
    tagged = docs.select("*", F.col("_metadata.file_path").alias("_at_file"), F.col("_metadata.row_index").alias("_at_row"))
    groups = store(near_groups(tagged, id_col, text_col, size, max_bits, carry=("_at_file", "_at_row")), "simhash-groups")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("_at_file").alias("f"), F.col("_at_row").alias("r")))
    kept = groups.groupBy("root").agg(first.alias("b")).select(F.col("b.f").alias("_kf"), F.col("b.r").alias("_kr"))
    return docs.join(kept, (F.col("_metadata.file_path") == F.col("_kf")) & (F.col("_metadata.row_index") == F.col("_kr")), "left_semi")
