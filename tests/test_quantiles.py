"""Sort-based exact quantiles equal Spark's exact percentile, also with a hot group."""

from pyspark.sql import functions as F

from harvestry.operators.quantiles import exact_quantiles, quantiles_builtin, value_counts_ranged


def _same(a, b, keys):
    a = a.toPandas().sort_values(keys).reset_index(drop=True)
    b = b.toPandas().sort_values(keys).reset_index(drop=True)
    assert a.equals(b)


def test_grouped_and_global(spark):
    df = spark.range(0, 20000).select((F.col("id") % 7).alias("g"), (F.sin("id") * 100).alias("x"))
    probs = [0.05, 0.25, 0.5, 0.75, 0.95]
    _same(exact_quantiles(df, "x", probs, ["g"]), quantiles_builtin(df, "x", probs, ["g"]), ["g"])
    _same(exact_quantiles(df, "x", probs).withColumn("k", F.lit(1)),
          quantiles_builtin(df, "x", probs).withColumn("k", F.lit(1)), ["k"])


def test_hot_group_and_ties(spark):
    # one group holds half the rows, many tied values
    df = spark.range(0, 30000).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise((F.col("id") % 5).cast("string")).alias("g"),
                                      F.floor(F.col("id") / 7).cast("double").alias("x"))
    df = df.repartition(16)
    _same(exact_quantiles(df, "x", [0.1, 0.5, 0.9], ["g"]), quantiles_builtin(df, "x", [0.1, 0.5, 0.9], ["g"]), ["g"])


def test_nulls_ignored_single_row(spark):
    df = spark.createDataFrame([("a", None), ("a", 3.0), ("b", 1.0)], "g string, x double")
    out = {r.g: r.q50 for r in exact_quantiles(df, "x", [0.5], ["g"]).collect()}
    assert out == {"a": 3.0, "b": 1.0}


def test_hot_value_is_folded_before_the_shuffle(spark):
    """One value in 90 % of the rows is one row of the range-partitioned counts; no partition holds more than its share."""
    df = spark.range(0, 40000).select(F.lit("g").alias("g"), F.when(F.col("id") % 10 > 0, F.lit(5.0)).otherwise(F.col("id").cast("double")).alias("x"))
    counts = value_counts_ranged(df, "x", ["g"])
    per_task = [r["count"] for r in counts.groupBy("__p").count().collect()]
    assert sum(per_task) == 4001 and max(per_task) < 4 * 4000 / len(per_task) + 100  # 0, 10, ... and 5.0
    assert counts.where("__x = 5.0").count() == 1
    _same(exact_quantiles(df, "x", [0.05, 0.5, 0.95], ["g"]), quantiles_builtin(df, "x", [0.05, 0.5, 0.95], ["g"]), ["g"])


def test_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 4.0), ("b", 1.0)], "g string, x double")
    assert {r.g: r.q50 for r in exact_quantiles(df, "x", [0.5], ["g"]).collect()} == {None: 2.5, "b": 1.0}
