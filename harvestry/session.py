"""Session construction and shared-storage locations."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


# Whole-stage codegen emits methods above HotSpot's 8000-byte JIT limit for
# wide projections (36 features, 4 crop scores); without this flag those
# methods stay in the bytecode interpreter.
JIT_OPTIONS = "-XX:-DontCompileHugeMethods"


#: The largest method that HotSpot compiles by default. Spark's own limit for generated code is 65,535 bytes; a stage above
#: HotSpot's is left in the bytecode interpreter, where split code outside whole-stage generation would be compiled.
HOTSPOT_METHOD_BYTES = 8000


def fit_codegen_to_jit(spark: SparkSession) -> None:
    """Set ``spark.sql.codegen.hugeMethodLimit`` to HotSpot's limit, unless it is set or the JVMs compile methods of any size."""
    conf = spark.sparkContext.getConf()
    where = "driver" if spark.sparkContext.master.startswith("local[") else "executor"
    if "-DontCompileHugeMethods" not in (conf.get(f"spark.{where}.extraJavaOptions") or "") and not conf.contains("spark.sql.codegen.hugeMethodLimit"):
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(HOTSPOT_METHOD_BYTES))


#: Where each partition of one side is at most so large, a join that is not broadcast hashes that side: neither side is sorted, and
#: nothing is spilled. Not below ``spark.sql.adaptive.advisoryPartitionSizeInBytes``, or Spark leaves it out.
HASHED_PARTITIONS, HASHED_BYTES = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m"


def hash_small_partitions(spark: SparkSession) -> None:
    """Set ``HASHED_PARTITIONS``, unless it is set."""
    if not spark.sparkContext.getConf().contains(HASHED_PARTITIONS):
        spark.conf.set(HASHED_PARTITIONS, HASHED_BYTES)


#: With this setting Spark removes a query's shuffle files when the query has ended.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_parquet(df: DataFrame, path: str, **options: str) -> None:
    """Write ``df`` to ``path``. The shuffle files that this took go as soon as it is written; without that, a session keeps those
    of all its writes until the driver's garbage collector runs."""
    conf = df.sparkSession.conf
    before = conf.get(DROP_SHUFFLES, None)
    conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.unset(DROP_SHUFFLES) if before is None else conf.set(DROP_SHUFFLES, before)


def build_session(master: str | None = None, partitions: int = 8, app: str = "harvestry") -> SparkSession:
    """Session for tests and the bench: AQE on, UI off, UTC."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("HARVESTRY_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.extraJavaOptions", JIT_OPTIONS)
        .config("spark.executor.extraJavaOptions", JIT_OPTIONS)
    )
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` is used as is. Without that
    setting a local folder is chosen in local mode only (tests on a laptop); on
    a cluster it would not be shared, so its absence is an error.
    """
    sc = spark.sparkContext
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = os.environ.get("HARVESTRY_CHECKPOINT_DIR", "/tmp/harvestry-checkpoints")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(conf_dir)
    return conf_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written table."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/harvestry/{name}-{uuid.uuid4().hex[:12]}"


def stable_path(spark: SparkSession, name: str) -> str:
    """The path of a lasting table under the shared folder: the same in every call and session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/harvestry/{name}"
