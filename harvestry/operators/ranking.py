"""W*, O*, U*: ranking, ordering, sampling, splitting and set operations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestry.functions.numeric import hash_bucket


def average_rank(df: DataFrame, score: str, alias: str, ascending: bool = False) -> DataFrame:
    """Rank with ties averaged (pandas ``rank(method='average')``).

    A global window: only for small tables (e.g. one row per feature)."""
    o = F.col(score).asc() if ascending else F.col(score).desc()
    r = F.rank().over(Window.orderBy(o))
    ties = F.count(F.lit(1)).over(Window.partitionBy(score))
    return df.withColumn(alias, r + (ties - 1) / F.lit(2.0))


def mean_rank(df: DataFrame, key: str, scores: Sequence[str]) -> DataFrame:
    """Average-tie rank per score column, then the mean rank."""
    out = df
    for s in scores:
        out = average_rank(out, s, f"{s}_rank")
    mean = sum((F.col(f"{s}_rank") for s in scores[1:]), F.col(f"{scores[0]}_rank")) / F.lit(float(len(scores)))
    return out.withColumn("mean_rank", mean)


def cumulative_share(df: DataFrame, order: Sequence[Column], value: str, alias: str = "cum_share") -> DataFrame:
    """Running sum of a share column (small ordered table)."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(alias, F.sum(value).over(w))


def components_for(cum: DataFrame, k: str, cum_col: str, thresholds: Sequence[float]) -> DataFrame:
    """Smallest k whose cumulative share reaches each threshold (one aggregate)."""
    return cum.agg(*[F.min(F.when(F.col(cum_col) >= F.lit(t), F.col(k))).alias(f"k_{int(round(t * 100))}")
                     for t in thresholds])


def top_n(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """O1/O2: a top-k report (TakeOrderedAndProject: n rows kept per task)."""
    return df.orderBy(*order).limit(n)


def row_max_abs(cols: Sequence[str]) -> Column:
    """O3: max of absolute values across columns."""
    return F.greatest(*[F.abs(F.col(c)) for c in cols])


def undo_one_hot(prefix: str, values: Sequence[str]) -> Column:
    """Name of the column holding the row maximum (first on ties)."""
    cols = [f"{prefix}_{v}" for v in values]
    mx = F.greatest(*[F.col(c) for c in cols])
    out = None
    for v, c in zip(values, cols):
        out = F.when(F.col(c) == mx, F.lit(v)) if out is None else out.when(F.col(c) == mx, F.lit(v))
    return out


def hash_order_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(str(seed))))


def sample_exact(df: DataFrame, n: int, key: Column, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows without replacement, deterministic for a seed:
    the ``n`` smallest md5(key || seed).

    A histogram of the first three hash digits (4,096 counts) tells which
    prefix of the hash range holds n rows; only those rows, about n of them
    and one bucket more, go to the final top-n."""
    hashed = df.withColumn("__h", hash_order_key(key, seed))
    bucket = F.substring("__h", 1, 3)
    counts = hashed.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy("b")))  # at most 4,096 rows
    cut = upto.agg(F.coalesce(F.min(F.when(F.col("upto") >= n, F.col("b"))), F.lit("fff")).alias("cut")).scalar()
    return hashed.where(bucket <= cut).orderBy("__h", key).limit(n).drop("__h")


def split_flag(key: Column, test_pct: int = 20, seed: int = 42) -> Column:
    """Test-set membership from the first 32 bits of md5(key || seed); no
    pass over the data, size within sampling error of ``test_pct``."""
    return hash_bucket(F.concat(key.cast("string"), F.lit(str(seed))), 100) < test_pct


def fold_id(key: Column, folds: int = 5, seed: int = 42) -> Column:
    """Fold number 0..folds-1 by hash, sizes within sampling error."""
    return hash_bucket(F.concat(key.cast("string"), F.lit(str(seed))), folds).cast("int")


def hash_cuts(df: DataFrame, key: Column, ranks: Callable[[int], Sequence[int]], seed: int = 42) -> list[str]:
    """For each of ``ranks(number of rows)``, the hash with exactly so many rows below it in the order of md5(key || seed).

    Nothing is sorted: a histogram of the first three hex digits shows which
    bucket holds each cut, and only that bucket's rows go to a histogram of the
    next three, until the cut falls between two buckets. Each histogram has at
    most 4,096 counts for each cut. Rows that share a key stay together, so a
    cut inside them moves in front of them. A null key counts as empty.
    """
    h = hash_order_key(F.coalesce(key.cast("string"), F.lit("")), seed)
    hashed = df.select(h.alias("h"))
    depth, wanted, found, places = 3, None, {}, {}
    while wanted is None or wanted:
        rows = hashed if wanted is None else hashed.where(F.substring("h", 1, depth - 3).isin(sorted({p for p, _ in wanted.values()})))
        counts = sorted((r.b, r.n) for r in rows.groupBy(F.substring("h", 1, depth).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
        if wanted is None:
            places = list(ranks(sum(n for _, n in counts)))
            wanted = {i: ("", r) for i, r in enumerate(places)}
        for i, (prefix, left) in list(wanted.items()):
            for b, n in counts:
                if not b.startswith(prefix):
                    continue
                if left < n:
                    if left == 0 or depth >= 32:
                        found[i] = b
                        del wanted[i]
                    else:
                        wanted[i] = (b, left)
                    break
                left -= n
            else:  # every row lies below
                found[i] = "g"
                del wanted[i]
        depth = min(depth + 3, 32)
    return [found[i] for i in range(len(places))]


def exact_split(df: DataFrame, key: Column, test_pct: int = 20, seed: int = 42) -> Column:
    """True for exactly ceil(n * test_pct / 100) rows, the first in the hash order; decided in the row by one comparison."""
    (cut,) = hash_cuts(df, key, lambda n: [-(-n * test_pct // 100)], seed)
    return hash_order_key(F.coalesce(key.cast("string"), F.lit("")), seed) < F.lit(cut)


def exact_folds(df: DataFrame, key: Column, folds: int = 5, seed: int = 42) -> Column:
    """Fold 0..folds-1, consecutive stretches of the hash order; the first n % folds of them have one row more."""
    cuts = hash_cuts(df, key, lambda n: [n // folds * i + min(i, n % folds) for i in range(1, folds)], seed)
    h = hash_order_key(F.coalesce(key.cast("string"), F.lit("")), seed)
    return sum(((h >= F.lit(c)).cast("int") for c in cuts), F.lit(0))


def arg_max(df: DataFrame, by: Sequence[str], value: str, label: str) -> DataFrame:
    """The label of the row with the largest value per group (ties: the
    smallest label). Two-phase ``max`` of a struct."""
    m = F.min(F.struct((-F.col(value)).alias("nv"), F.col(label).alias("l")))
    return df.groupBy(*by).agg(m.alias("_m")).select(*by, F.col("_m.l").alias(label), (-F.col("_m.nv")).alias(value))


def category_overlap(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Values in both, only left, only right (distinct sets)."""
    a = left.select(column).where(F.col(column).isNotNull()).distinct()
    b = right.select(column).where(F.col(column).isNotNull()).distinct()
    both = a.intersect(b).withColumn("status", F.lit("both"))
    only_a = a.join(b, column, "left_anti").withColumn("status", F.lit("left_only"))
    only_b = b.join(a, column, "left_anti").withColumn("status", F.lit("right_only"))
    return both.unionByName(only_a).unionByName(only_b)


def excluded_categories(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Values of ``left`` absent from ``right`` (computed, not listed)."""
    return left.select(column).where(F.col(column).isNotNull()).subtract(right.select(column))
