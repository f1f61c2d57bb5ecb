"""Exact deduplication as a stateful stream, with built-in functions only.

1. ``content_index``: one slim row per document - digest of the normalised text,
   length, id and content locator (file, row in it) - written to the shared folder.
2. A Structured Streaming aggregation keyed by digest reads that index. Its
   state (RocksDB, no watermark, so nothing expires) retains for each digest the
   number of rows and the id and locator of the row that stays. Partial
   aggregation folds a hot group inside each task before the shuffle. With the
   same ``state_dir`` a later run adds its index files to the kept state.
3. The state is read back as a table. Every row of a digest with two or more
   rows is a hit: its whole normalised text is compared with the text behind the
   retained locator. Hits get their salt while they are still slim rows, so texts
   move by their own locator and then by (digest, salt): a group of any size is
   spread over tasks, and the retained text is copied once for each ``SALT_ROWS``
   members. A later run compares its own rows; of the rows of earlier runs, whose
   bytes have been compared, one stands for the others, read again by its locator.
4. Rows of a digest whose bytes differ are grouped by their whole text instead, so
   a digest collision cannot merge different texts. Such digests stay known.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.llm.common import BLANK_CLASS, join_hot, store, whole_text
from harvestry.session import shared_path

SALT_ROWS = 64
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, BLANK_CLASS + "+", "")


def sha256_digest(norm: Column) -> Column:
    return F.sha2(norm, 256)


def located(docs: DataFrame) -> DataFrame:
    """``docs`` read from files, so that each row has a locator; other frames are written first."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
        return docs
    except AnalysisException as e:
        if "_metadata" not in str(e):
            raise
        return store(docs, "exact-input")


def content_index(docs: DataFrame, digest, id_col: str, text_col: str) -> DataFrame:
    text = whole_text(text_col)
    return docs.select(
        F.col(id_col).alias("id"), digest(normalised(text)).alias("digest"), F.length(text).cast("long").alias("n"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _preference() -> Column:
    """Smallest first: most code points, then a non-null id, then the smallest id, then the locator."""
    return F.struct((-F.col("n")).alias("neg_n"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"),
                    F.col("file").alias("file"), F.col("row").alias("row"))


def stream_state(spark: SparkSession, index_path: str, schema, state_dir: str) -> DataFrame:
    """Run the stream over the index files not seen yet; return (digest, rows, best) from the state store."""
    session = spark.newSession()  # the settings below stay out of the caller's session
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # else each small store takes megabytes
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = (session.readStream.schema(schema).option("recursiveFileLookup", True).parquet(index_path)
             .groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.min(_preference()).alias("best")))
    (keyed.writeStream.outputMode("update").format("noop").option("checkpointLocation", state_dir)
     .trigger(availableNow=True).start().awaitTermination())
    state = spark.read.format("statestore").load(state_dir)
    held = state.schema["value"].dataType.names
    return state.select(F.col("key")["digest"].alias("digest"), F.col("value")[held[0]].alias("rows"),
                        F.col("value")[held[1]].alias("best"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    """(file, row, norm) of each row."""
    return docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), normalised(whole_text(text_col)).alias("norm"))


def _texts_of(rows: DataFrame, docs: DataFrame, text_col: str, run_id: str) -> DataFrame:
    """``rows`` (file, row, run, ...) with their whole normalised text, from ``docs`` or, for earlier runs, from the Parquet files of their locators."""
    # a merge join whatever the sizes: a broadcast that only small inputs get would hide what large ones shuffle
    now = rows.filter(F.col("run") == run_id).hint("merge").join(_texts(docs, text_col), ["file", "row"])
    files = [r.file for r in rows.filter(F.col("run") != run_id).select("file").distinct().collect()]  # input files, of which the driver holds listings anyway
    if not files:
        return now
    old = _texts(rows.sparkSession.read.parquet(*files), text_col)
    return now.unionByName(rows.filter(F.col("run") != run_id).join(old, ["file", "row"]))


def _collided(docs: DataFrame, index: DataFrame, groups: DataFrame, text_col: str, run_id: str) -> DataFrame:
    """Digests of which a row of this run has other bytes than the retained row, or the retained row other than those of earlier runs."""
    locator = F.struct("file", "row")
    old = index.filter(F.col("run") != run_id)
    hits = join_hot(index, groups.filter("rows > 1"), ["digest"], "rows").select(
        "digest", "file", "row", "run", F.ceil(F.col("rows") / SALT_ROWS).cast("long").alias("salts"),
        ((F.col("best.file") == F.col("file")) & (F.col("best.row") == F.col("row"))).alias("is_best"))
    if not old.isEmpty():
        here = index.filter(F.col("run") == run_id).select("digest").distinct()
        one = old.groupBy("digest").agg(F.min(locator).alias("one")).join(here, "digest").select(F.col("one.file").alias("file"), F.col("one.row").alias("row"))
        stands = hits.filter(F.col("run") != run_id).join(one, ["file", "row"], "left_semi")
        kept = hits.filter((F.col("run") != run_id) & F.col("is_best")).join(here, "digest", "left_semi")
        hits = hits.filter(F.col("run") == run_id).unionByName(stands.unionByName(kept).distinct())
    hits = store(hits, "exact-hits")
    texts = _texts_of(hits, docs, text_col, run_id)
    members = texts.withColumn("salt", F.pmod(F.xxhash64("file", "row"), F.col("salts"))).select("digest", "salt", "norm")
    retained = (texts.filter("is_best").select("digest", F.col("norm").alias("kept_norm"),
                                               F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")))
    return members.hint("merge").join(retained, ["digest", "salt"]).filter("norm != kept_norm").select("digest").distinct()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_digest,
                 state_dir: str | None = None, run_id: str | None = None) -> DataFrame:
    """One row per input row of this and all earlier runs on ``state_dir``: id, keep_id, group_size, kept, digest, file, row, run.

    Texts are equal when identical after deleting ASCII white space; null counts
    as empty, and empty texts equal each other. Of equal texts the row with the
    most code points in the original text stays, then the smallest id (null ids
    last), then, among repeated rows, the first locator; exactly one row of each
    group has ``kept``. A row of an earlier run may lose its place to one of this
    run; its row here says so. A call repeated with its ``run_id`` adds nothing.
    Inputs of runs that share a state are Parquet files that stay where they are.
    """
    spark = docs.sparkSession
    docs = located(docs)
    state, run_id = state_dir or shared_path(spark, "exact-state"), run_id or uuid.uuid4().hex
    fresh = content_index(docs, digest, id_col, text_col).withColumn("run", F.lit(run_id))
    if not _exists(spark, f"{state}/index/run-{run_id}/_SUCCESS"):
        fresh.write.mode("overwrite").parquet(f"{state}/index/run-{run_id}")
    index = spark.read.schema(fresh.schema).option("recursiveFileLookup", True).parquet(f"{state}/index")
    groups = store(stream_state(spark, f"{state}/index", fresh.schema, f"{state}/checkpoint"), "exact-groups")
    collided = store(_collided(docs, index, groups, text_col, run_id), "exact-collided")
    known = f"{state}/collided"
    if not collided.isEmpty():
        collided.write.mode("append").parquet(known)
    rows = join_hot(index, groups, ["digest"], "rows")
    if _exists(spark, known):
        rows = _by_text(rows, spark.read.schema(collided.schema).parquet(known).distinct(), docs, text_col, run_id)
    kept = (F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))
    return rows.select("id", F.col("best.id").alias("keep_id"), F.col("rows").alias("group_size"), kept.alias("kept"),
                       "digest", "file", "row", "run")


def _by_text(rows: DataFrame, collided: DataFrame, docs: DataFrame, text_col: str, run_id: str) -> DataFrame:
    """``rows`` with those of collided digests grouped by (digest, whole text)."""
    plain = rows.join(collided, "digest", "left_anti")
    full = store(_texts_of(rows.join(collided, "digest", "left_semi").drop("rows", "best"), docs, text_col, run_id), "exact-texts")
    regrouped = full.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("rows"), F.min(_preference()).alias("best"))
    parted = join_hot(full, regrouped, ["digest", "norm"], "rows")
    return plain.unionByName(parted.select(*plain.columns))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns unchanged."""
    docs = located(docs)
    kept = (exact_groups(docs, id_col, text_col).filter("kept")
            .select(F.col("file").alias("_kept_file"), F.col("row").alias("_kept_row")))
    return docs.join(kept, (F.col("_metadata.file_path") == F.col("_kept_file"))
                     & (F.col("_metadata.row_index") == F.col("_kept_row")), "left_semi")
