"""Delimited sources, loaders, sinks and stage materialisation.

Loaders read every column as text (no schema-inference pass over the data)
and then type it explicitly: ``try_cast`` for numbers, exact 'True'/'False'
for flags. Written tables go under the cluster's shared checkpoint folder.
"""

from __future__ import annotations

import csv
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from harvestry.operators.cleaning import coerce_numeric, normalize_columns, parse_boolean_columns

def write_csv(df: DataFrame, path: str, headers: Mapping[str, str] | None = None) -> str:
    """Write with a header row; ``headers`` renames columns to raw spellings."""
    out = df.select(*[F.col(c).alias(headers.get(c, c)) if headers else F.col(c) for c in df.columns])
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def _as_utf8(text: Column) -> Column:
    """A value read as Latin-1 holds its bytes one for one; here they are taken as UTF-8."""
    return F.encode(text, "ISO-8859-1").cast("string")


def _decode_name(name: str) -> str:
    try:
        return name.encode("latin-1").decode("utf-8")
    except UnicodeError:
        return name


def read_delimited(spark: SparkSession, path: str, schema: StructType | None = None,
                   header: bool = True, sep: str = ",") -> DataFrame:
    """Delimited scan with header. A file whose text is all valid UTF-8 is
    UTF-8, any other is Latin-1, whatever single values of it would pass for.

    The bytes are read as Latin-1, which loses nothing. One aggregate over the
    plain lines (delimiters are ASCII, so a line is valid where its values are)
    finds the files with an invalid one; they are joined back by path, by broadcast: at
    most a row per file, of which the driver holds the listing anyway. Nothing
    runs before the result is asked for. A genuine U+FFFD stays. Without a
    schema all columns are text, named by the header (without one, by Spark)."""
    if schema is None:
        schema = all_text_schema(spark, path, sep) if header else spark.read.option("sep", sep).csv(path).schema
    df = (spark.read.option("header", header).option("sep", sep).option("encoding", "ISO-8859-1")
          .option("mode", "PERMISSIVE").schema(schema).csv(path))
    texts = [f.name for f in schema.fields if isinstance(f.dataType, StringType)]
    if not texts:
        return df
    raw = df.select("*", F.col("_metadata.file_path").alias("__file"))
    lines = spark.read.text(path).select(F.is_valid_utf8("value").alias("valid"), F.col("_metadata.file_path").alias("__latin"))
    latin = lines.groupBy("__latin").agg(F.bool_and("valid").alias("utf8")).where("not utf8").select("__latin")
    named = raw.join(F.broadcast(latin), F.col("__file") == F.col("__latin"), "left")
    return named.select(*[(F.when(F.col("__latin").isNull(), _as_utf8(F.col(f"`{f.name}`"))).otherwise(F.col(f"`{f.name}`")).alias(f.name)
                           if f.name in texts else F.col(f"`{f.name}`")) for f in schema.fields])


def all_text_schema(spark: SparkSession, path: str, sep: str = ",") -> StructType:
    """Header names as an all-string schema. The driver reads the first line of one file; no job runs."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(conf)
    if fs.getFileStatus(place).isDirectory():
        names = sorted(s.getPath().toString() for s in fs.listStatus(place)
                       if s.isFile() and s.getLen() and not s.getPath().getName().startswith(("_", ".")))
        if not names:
            return StructType([])
        place = jvm.org.apache.hadoop.fs.Path(names[0])
    codec, stream = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place), fs.open(place)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "ISO-8859-1"))
    try:
        line = reader.readLine()
    finally:
        reader.close()
    return StructType([StructField(_decode_name(n), StringType()) for n in next(csv.reader([line or ""], delimiter=sep), [])])


def load_text_table(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, all_text_schema(spark, path))


def load_observations(spark: SparkSession, path: str) -> DataFrame:
    """Normalise names, parse flags, type numbers."""
    df = normalize_columns(load_text_table(spark, path))
    df = parse_boolean_columns(df, ["fertilizer_used", "irrigation_used"])
    return df.withColumns({
        "rainfall_mm": coerce_numeric("rainfall_mm"),
        "temperature_celsius": coerce_numeric("temperature_celsius"),
        "days_to_harvest": F.col("days_to_harvest").try_cast("int"),
        "yield_tons_per_hectare": coerce_numeric("yield_tons_per_hectare"),
    })


def _int(c):
    return F.col(c).try_cast("int")


def load_ref_yield(spark: SparkSession, path: str) -> DataFrame:
    """S3: Area/Item/Year/Value -> country/crop/year/yield_hg_ha; rows without
    a numeric value are dropped."""
    df = load_text_table(spark, path).withColumnsRenamed(
        {"Area": "country", "Item": "crop", "Year": "year", "Value": "yield_hg_ha"})
    df = df.select("country", "crop", _int("year").alias("year"), coerce_numeric("yield_hg_ha").alias("yield_hg_ha"))
    return df.na.drop(subset=["yield_hg_ha"])


def load_ref_pesticides(spark: SparkSession, path: str) -> DataFrame:
    """Nulls are kept."""
    df = load_text_table(spark, path).withColumnsRenamed({"Area": "country", "Year": "year", "Value": "pesticides_tonnes"})
    return df.select("country", _int("year").alias("year"), coerce_numeric("pesticides_tonnes").alias("pesticides_tonnes"))


def load_ref_rainfall(spark: SparkSession, path: str) -> DataFrame:
    """The header may read ' Area'; names are stripped first."""
    df = normalize_columns(load_text_table(spark, path), lower=False)
    df = df.withColumnsRenamed({"Area": "country", "Year": "year", "average_rain_fall_mm_per_year": "rainfall_mm"})
    return df.select("country", _int("year").alias("year"), coerce_numeric("rainfall_mm").alias("rainfall_mm"))


def load_ref_temperature(spark: SparkSession, path: str) -> DataFrame:
    """S6."""
    df = load_text_table(spark, path)
    return df.select("country", _int("year").alias("year"), coerce_numeric("avg_temp").alias("avg_temp"))


def load_premerged(spark: SparkSession, path: str) -> DataFrame:
    """Drop the index column when present, rename, type the numbers."""
    df = load_text_table(spark, path)
    df = df.drop("Unnamed: 0") if "Unnamed: 0" in df.columns else df
    df = df.withColumnsRenamed({"Area": "country", "Item": "crop", "Year": "year", "hg/ha_yield": "yield_hg_ha",
                                "average_rain_fall_mm_per_year": "rainfall_mm"})
    num = [c for c in ("yield_hg_ha", "rainfall_mm", "pesticides_tonnes", "avg_temp") if c in df.columns]
    return df.withColumns({"year": _int("year"), **{c: coerce_numeric(c) for c in num}})


def table_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, columns and null cells per table (one aggregate each)."""
    out = None
    for name, df in tables.items():
        nulls = None
        for c in df.columns:
            t = F.sum(F.col(f"`{c}`").isNull().cast("long"))
            nulls = t if nulls is None else nulls + t
        row = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n_rows"),
                     F.lit(len(df.columns)).alias("n_cols"), F.coalesce(nulls, F.lit(0)).cast("long").alias("n_nulls"))
        out = row if out is None else out.unionByName(row)
    return out


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Overwrite sink (Parquet by default, CSV with header on request)."""
    w = df.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path))
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS"))


def materialize(df: DataFrame, path: str, skip_if_exists: bool = True) -> DataFrame:
    """A stage output written once to shared storage; later runs read it.
    Reading it back also cuts the lineage, so a lost executor recomputes from
    the written files instead of from the sources."""
    spark = df.sparkSession
    if not (skip_if_exists and path_exists(spark, path)):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
