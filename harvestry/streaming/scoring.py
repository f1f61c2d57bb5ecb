"""Structured Streaming uses of the batch operators.

Scoring and validation are row-local expressions, so the same functions run on a
streaming DataFrame. Ranking and grid search (W1/R3) group rows, which streams do
not allow outside a time window; they run on each micro-batch. The file source and
the sinks live under the shared checkpoint folder, with a checkpoint location per
query, so a restarted query resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from harvestry.operators.scoring import optimize_best, predict_yield, recommend_crops
from harvestry.operators.validation import validate


def stream_score(spark: SparkSession, source_dir: str, schema: StructType, model, sink_dir: str,
                 checkpoint_dir: str, keep=None) -> DataFrame:
    """Read a directory of scenario files as a stream, score every new
    record, append to a Parquet sink; run until the input is drained
    (``availableNow``) and return the sink as a batch DataFrame."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source_dir)
    scored = predict_yield(stream, model, keep)
    q = (scored.writeStream.format("parquet").outputMode("append")
         .option("path", sink_dir).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink_dir)


def stream_validate(spark: SparkSession, source_dir: str, schema: StructType, accepted_dir: str,
                    rejected_dir: str, checkpoint_dir: str) -> DataFrame:
    """Split a stream into accepted and quarantined records (two sinks).
    ``foreachBatch`` writes both outputs of each micro-batch; the batch id
    makes a replayed batch overwrite its own partition instead of duplicating."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    checked = validate(stream).withColumn("reasons", F.concat_ws("; ", "reasons"))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        b = batch.withColumn("batch_id", F.lit(batch_id)).persist()  # read and checked once for the two sinks
        try:
            b.where("is_valid").drop("is_valid").write.mode("overwrite").parquet(f"{accepted_dir}/batch_id={batch_id}")
            b.where("not is_valid").drop("is_valid").write.mode("overwrite").parquet(f"{rejected_dir}/batch_id={batch_id}")
        finally:
            b.unpersist()

    q = (checked.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    acc = spark.read.parquet(accepted_dir).withColumn("accepted", F.lit(True))
    rej = spark.read.parquet(rejected_dir).withColumn("accepted", F.lit(False))
    return acc.unionByName(rej).drop("batch_id")


def _sink(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """All batches of a sink; without any, no rows."""
    schema = like.schema
    try:
        return spark.read.schema(schema).parquet(f"{folder}/batch_id=*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def stream_decide(spark: SparkSession, source_dir: str, schema: StructType, model, sink_dir: str, checkpoint_dir: str,
                  keep: list[str] | None = None, files_per_batch: int = 64) -> tuple[DataFrame, DataFrame]:
    """Rank the crops and search the management grid for every new scenario.

    Each micro-batch is ranked and searched by the batch operators and written to
    two sinks in folders of its batch id, which a replay after a crash overwrites,
    so nothing is doubled or lost. Returns (rankings, best configurations)."""
    ids = keep or ["scenario_id"]
    grid_keep = [*ids, "crop"] if "crop" not in ids else ids
    parts = {"rankings": lambda df: recommend_crops(df, model, ids), "best": lambda df: optimize_best(df, model, grid_keep)}

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # each sink reads the batch's files, which takes less than keeping their rows in memory
        for name, decide in parts.items():
            decide(batch).write.mode("overwrite").parquet(f"{sink_dir}/{name}/batch_id={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source_dir)
    (stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
     .trigger(availableNow=True).start().awaitTermination())
    empty = spark.createDataFrame([], schema)
    return tuple(_sink(spark, f"{sink_dir}/{name}", decide(empty)) for name, decide in parts.items())
