"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestry.session import shared_path, write_parquet

#: ASCII white space, the separators of words in every contract.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def write_table(df: DataFrame, name: str, **options: str) -> str:
    """Write ``df`` to a new folder of the shared folder; operators that write in rounds leave no shuffle files behind."""
    path = shared_path(df.sparkSession, name)
    write_parquet(df, path, **options)
    return path


def store(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage at a table that survives lost executors; both later reads
    and retries start from the files instead of from the corpus.
    """
    path = write_table(df, name, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that ``write_table`` made and nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a non-null text, an empty array if it has none."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK_CLASS + "+"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def schema_of(df: DataFrame) -> T.StructType:
    """The schema of ``df`` with every column nullable, for the output of Python workers."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])


#: A group with more than this part of all matching rows is hot, so there are fewer of them than this.
HOT_GROUPS = 1 << 13


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` joined to ``groups``, one row per key, whose column ``size`` is the number of rows that match it.

    Hot groups are joined by broadcast, as there are fewer than ``HOT_GROUPS`` of
    these whatever the input; the others go through the shuffle, none of them with
    more than a ``HOT_GROUPS``-th of the rows. The share alone decides, so plans are
    alike at every size.
    """
    is_hot = F.col(size) > groups.agg(F.sum(size)).scalar() / HOT_GROUPS
    hot = F.broadcast(groups.filter(is_hot))
    cold = rows.join(hot.select(*keys), keys, "left_anti").hint("merge").join(groups.filter(~is_hot), keys)
    return rows.join(hot, keys).unionByName(cold)
