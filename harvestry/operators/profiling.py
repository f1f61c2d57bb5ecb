"""One-pass statistics and profiles.

Wide statistics are computed in a single aggregate (one scan) and unpivoted;
per-feature work that needs a second pass (bins, whiskers) joins a table with
one row per feature or group back to the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.functions.numeric import np_round, own_step
from harvestry.operators.aggregates import long_format
from harvestry.operators.quantiles import exact_quantiles


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson r; NULL when either side has no variance (``corr`` would
    divide by zero under ANSI)."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx == 0) | (sy == 0), F.lit(None).cast("double")).otherwise(F.covar_pop(x, y) / (sx * sy))


def feature_rows(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(i, x, y): a row per row of ``df`` and feature, with the feature's position, its value and the target's."""
    values = F.array(*[F.col(f).cast("double") for f in features])
    # the array is never empty; without "outer", the optimiser would make it once more to see that
    return (df.select(values.alias("_x"), own_step(F.col(target).cast("double")).alias("y"))
            .select(F.posexplode_outer("_x").alias("i", "x"), "y"))


def by_position(value: str, n: int) -> list[Column]:
    """Aggregates of a table with one row per position ``i``: its values in order, null where a position is absent."""
    return [F.max(F.when(F.col("i") == k, F.col(value))) for k in range(n)]


def corr_with_target(df: DataFrame, features: Sequence[str], target: str, digits: int = 9) -> DataFrame:
    """R and |r| of every feature with the target: one two-phase aggregate with a row per feature and task."""
    per = feature_rows(df, features, target).groupBy("i").agg(safe_corr(F.col("x"), F.col("y")).alias("r"))
    one = per.agg(*[r.alias(f) for f, r in zip(features, by_position("r", len(features)))])
    return (one.unpivot([], list(features), "feature", "r")
            .select("feature", np_round("r", digits).alias("r"), np_round(F.abs("r"), digits).alias("abs_r")))


def corr_matrix(df: DataFrame, columns: Sequence[str], digits: int = 9) -> DataFrame:
    """Lower triangle (i < j) of the Pearson matrix, long form."""
    return pair_correlations(df, [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]], digits)


def pair_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]], digits: int = 9) -> DataFrame:
    """Pearson r of each pair of columns, one aggregate."""
    one = df.agg(*[safe_corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"{a}__{b}").alias("r"))
                     for a, b in pairs])
    return one.select(F.inline(rows)).select("feature_a", "feature_b", np_round("r", digits).alias("r"))


def collinear_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], perfect: float = 0.999, high: float = 0.9) -> DataFrame:
    """Every pair asked for, flagged by |r| (> 0.999 PERFECT, > 0.9 HIGH, else blank)."""
    a = F.abs(F.col("r"))
    return pair_correlations(df, pairs).withColumn("flag", F.when(a > perfect, F.lit("PERFECT")).when(a > high, F.lit("HIGH")).otherwise(F.lit("")))


def corr_bands(corr: DataFrame, strong: float = 0.5, moderate: float = 0.2) -> DataFrame:
    """Strength band of |r|."""
    a = F.col("abs_r")
    return corr.withColumn("band", F.when(a >= strong, F.lit("strong")).when(a >= moderate, F.lit("moderate"))
                           .otherwise(F.lit("weak")))


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin index in [0, bins-1]; the last bin is closed."""
    raw = F.floor((v - lo) / (hi - lo) * F.lit(float(bins)))
    return F.when(hi == lo, F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1))).cast("int")


def mutual_information(df: DataFrame, features: Sequence[str], target: str, bins: int = 20,
                       digits: int = 9) -> DataFrame:
    """X5 (re-aimed): binned mutual information I(feature; target) in nats.

    Equal-width bins on both sides; the joint distribution is a grouped count
    (two-phase), the marginals are sums over that small table. This is a
    plug-in estimator, not the k-NN estimator of the single-machine original.
    """
    y, n = "y", len(features)
    cells = feature_rows(df.where(F.col(target).isNotNull()), features, target).where(F.col("x").isNotNull())
    # the range of each feature and of the target where the feature is present, in feature order; a range of one value is
    # as wide as infinity, so that all its values lie in bin 0
    per = cells.groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.min(y).alias("ylo"), F.max(y).alias("yhi"))
    width = lambda lo, hi: F.when(F.col(lo) == F.col(hi), F.lit(float("inf"))).otherwise(F.col(hi) - F.col(lo))
    per = per.select("i", F.struct("lo", width("lo", "hi").alias("w"), "ylo", width("ylo", "yhi").alias("yw")).alias("range"))
    ranges = per.agg(F.array(*by_position("range", n))).scalar()
    # the cell is one integer
    cells = cells.select("i", "x", y, F.get(ranges, F.col("i")).alias("r"))
    at = lambda v, lo, w: F.least(F.floor((F.col(v) - F.col(f"r.{lo}")) / F.col(f"r.{w}") * F.lit(float(bins))), F.lit(bins - 1)).cast("int")
    bx, by = at("x", "lo", "w"), at(y, "ylo", "yw")
    counted = cells.groupBy(((F.col("i") * bins + bx) * bins + by).alias("cell")).agg(F.count(F.lit(1)).alias("nxy"))
    name = F.element_at(F.array(*[F.lit(f) for f in features]), (F.floor(F.col("cell") / (bins * bins)) + 1).cast("int"))
    joint = counted.select(name.alias("feature"), (F.floor(F.col("cell") / bins) % bins).alias("bx"), (F.col("cell") % bins).alias("by"), "nxy")
    from pyspark.sql import Window
    wf = Window.partitionBy("feature")
    j = (joint.withColumn("n", F.sum("nxy").over(wf))
         .withColumn("nx", F.sum("nxy").over(Window.partitionBy("feature", "bx")))
         .withColumn("ny", F.sum("nxy").over(Window.partitionBy("feature", "by"))))
    term = (F.col("nxy") / F.col("n")) * F.log((F.col("nxy") * F.col("n")) / (F.col("nx") * F.col("ny")))
    return j.groupBy("feature").agg(np_round(F.sum(term), digits).alias("mi"))


def residual_summary(pred: DataFrame, y: str, yhat: str, digits: int = 6) -> DataFrame:
    """Mean, population std, exact P5/P95 and max |residual|."""
    res = pred.select((F.col(y) - F.col(yhat)).alias("residual"))
    q = exact_quantiles(res, "residual", [0.05, 0.95], [], ["p05", "p95"]).select(F.struct("p05", "p95")).scalar()
    moments = res.agg(np_round(F.avg("residual"), digits).alias("mean"),
                      np_round(F.stddev_pop("residual"), digits).alias("std"),
                      np_round(F.max(F.abs("residual")), digits).alias("max_abs")).withColumn("__q", q)
    return moments.select("mean", "std", np_round("__q.p05", digits).alias("p05"), np_round("__q.p95", digits).alias("p95"), "max_abs")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width histogram (last bin closed): bin, edges, count."""
    x = F.col(column).cast("double")
    lo = df.agg(F.min(x)).scalar()
    hi = df.agg(F.max(x)).scalar()
    w = (hi - lo) / F.lit(float(bins))
    b = _bin(x, lo, hi, bins)
    return (df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .select("bin", (lo + F.col("bin") * w).alias("left"), (lo + (F.col("bin") + 1) * w).alias("right"), "n"))


def boxplot_stats(df: DataFrame, by: Sequence[str], value: str, digits: int = 6) -> DataFrame:
    """Quartiles per group and whiskers at the last data point within
    1.5 IQR (no outliers drawn)."""
    q = exact_quantiles(df, value, [0.25, 0.5, 0.75], by, ["q1", "median", "q3"])
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    # the quartiles have one row per group; AQE broadcasts them if they are small and splits hot groups if not
    j = df.select(*by, F.col(value).alias("__v")).join(q, list(by))
    lo_f = F.col("q1") - F.lit(1.5) * F.col("iqr")
    hi_f = F.col("q3") + F.lit(1.5) * F.col("iqr")
    wh = j.groupBy(*by).agg(F.min(F.when(F.col("__v") >= lo_f, F.col("__v"))).alias("whisker_lo"),
                            F.max(F.when(F.col("__v") <= hi_f, F.col("__v"))).alias("whisker_hi"))
    return q.join(wh, list(by)).select(*by, *[np_round(c, digits).alias(c) for c in ("q1", "median", "q3", "iqr")],
                                       "whisker_lo", "whisker_hi")


def standardize(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """(x - mean) / population std; zero variance -> scale 1.

    The statistics are one scalar subquery, a struct with all of them."""
    stats = df.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])).scalar()
    out = []
    for c in columns:
        s = F.col("__stats")[f"s_{c}"]
        scale = F.when(s == 0, F.lit(1.0)).otherwise(s)
        out.append(np_round((F.col(c) - F.col("__stats")[f"m_{c}"]) / scale, digits).alias(c))
    return df.withColumn("__stats", stats).select(*keep, *out)


def regression_metrics(pred: DataFrame, y: str, yhat: str, digits: int = 6) -> DataFrame:
    """RMSE, MAE, R², MAPE (% over rows with y > 0) in one aggregate."""
    e = F.col(y) - F.col(yhat)
    vy = F.var_pop(y)
    return pred.agg(
        np_round(F.sqrt(F.avg(e * e)), digits).alias("rmse"),
        np_round(F.avg(F.abs(e)), digits).alias("mae"),
        np_round(F.lit(1.0) - F.avg(e * e) / F.when(vy == 0, F.lit(None)).otherwise(vy), digits).alias("r2"),
        np_round(F.avg(F.when(F.col(y) > 0, F.abs(e / F.col(y)))) * F.lit(100.0), digits).alias("mape"),
        F.count(F.lit(1)).alias("n"))
