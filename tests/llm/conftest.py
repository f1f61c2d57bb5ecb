import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use inside
    *[T.StructField(c, T.StringType()) for c in ("id", "digest", "rows", "file", "row", "h", "fp", "size", "target", "kept", "grp", "shard", "low_symbols", "docs", "key", "rule")],
])


def frame(spark, rows):
    """Documents from (doc_id, text, lang, source), with columns whose names clash with inner ones."""
    full = [(*r, len(r[1]) if r[1] is not None else None, *["x"] * 16) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls in every column, empty and blank texts, repeated rows, ties, one long text."""
    rng = random.Random(5)
    base = prose(rng, 60)
    lines = "A line that many hold\n" + prose(rng, 20) + "\n  a LINE that many hold \t\n\nshort"
    long = prose(rng, 20_000)
    return [(1, base, "en", "a"), (2, base.replace(" ", "\n"), "en", "a"), (3, None, "en", "b"), (4, "", None, None),
            (5, " \t\n\x0b\x0c\r", "de", "b"), (6, lines, "en", "a"), (7, lines + "\nmore words in it", "en", None),
            (8, long, "fr", "c"), (None, base + " tail", None, "c"), (None, None, None, None),
            (9, base, "en", "a"), (9, base, "en", "a"), (10, "naïve Ünï € 𝒳 \x1c\x85\u00a0 end", "de", "é"),
            (11, "one", "en", "a"), (12, lines, "en", "a")]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return frame(spark, messy_rows)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """The fixtures are tiny; tests of splitting set their own block sizes."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
