"""Stage materialisation and shared storage."""

from pyspark.sql import functions as F

from harvestry.session import ensure_checkpoint_dir, shared_path
from harvestry.sources.loaders import materialize, path_exists


def test_shared_path_under_checkpoint_dir(spark):
    root = ensure_checkpoint_dir(spark)
    p = shared_path(spark, "x")
    assert p.startswith(root.rstrip("/") + "/harvestry/x-")


def test_materialize_skips_existing(spark):
    path = shared_path(spark, "stage")
    first = materialize(spark.range(5).withColumn("v", F.col("id") * 2), path)
    assert path_exists(spark, path) and first.count() == 5
    # a different input must not overwrite an existing stage when skipping
    second = materialize(spark.range(50), path, skip_if_exists=True)
    assert sorted(r.v for r in second.collect()) == [0, 2, 4, 6, 8]
    third = materialize(spark.range(3).withColumn("v", F.lit(1)), path, skip_if_exists=False)
    assert third.count() == 3
