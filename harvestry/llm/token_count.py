"""Token counts by separator scan over flat, unindexed token files.

A flat file is a run of token ids with an end-of-document id after each
document and nothing that says where documents lie. It is stored as blocks of a
fixed number of ids (file, block, payload), whatever documents they cut, in a
Parquet table: any store that Spark reads serves, and a lost task is written
again. Raw ``.bin`` files of any length come in through ``blocks_from_files``, in
fixed-length splits. A null or empty text has no tokens before its separator;
repeated rows are written each; other columns are ignored, whatever their names.

Each block is searched for the separator in one vectorised comparison and gives
one summary row. A prefix scan over the summaries finds, for every block, how
many documents ended before it and how many tokens of an unfinished one it
continues. The scan has two levels (blocks within a run of ``RUN`` blocks, then
runs within a file), so a file of any size is not gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harvestry.llm.common import schema_of, store
from harvestry.llm.tokens import WORD_BPE, worker_encoder
from harvestry.llm.warc import filesystem

BLOCK_TOKENS = 1 << 16
RUN = 4096
#: Blocks of a raw file that one task reads (8 MB of two-byte ids).
SPLIT_BLOCKS = 64


def write_flat(docs: DataFrame, separator: int, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = WORD_BPE,
               block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Tokenise ``docs``: one flat file per input partition, as rows (file, block, tokens) and, for
    naming the documents afterwards, the order in which they were written (file, nth, id)."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().cast("long").alias("file"))
    zero = F.lit(0).cast("long")
    schema = schema_of(slim.select("file", zero.alias("block"), F.lit(b"").alias("tokens"), zero.alias("nth"), "id"))

    def run(batches):
        encoder = worker_encoder(tokenizer, specials_as_text=True)
        kind, rest, block, nth, file = encoder.dtype(), np.zeros(0), 0, 0, None
        rest = rest.astype(kind)

        def out(file, blocks, ids, id_type, first_block, first):
            k, m = len(blocks), len(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([file] * (k + m), pa.int64()), pa.array([first_block + i for i in range(k)] + [None] * m, pa.int64()),
                 pa.array(blocks + [None] * m, pa.binary()), pa.array([None] * k + [first + i for i in range(m)], pa.int64()),
                 pa.array([None] * k + ids, id_type)], names=["file", "block", "tokens", "nth", "id"])

        id_type = None
        for b in batches:
            id_type = b.schema.field("id").type
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                file = part.column("file")[0].as_py()
                ids = [x for t in part.column("text") for x in (encoder.encode(t.as_py()).astype(kind), np.array([separator], kind))]
                flat = np.concatenate([rest, *ids])
                whole = len(flat) // block_tokens
                yield out(file, [flat[i * block_tokens:(i + 1) * block_tokens].tobytes() for i in range(whole)],
                          part.column("id").to_pylist(), id_type, block, nth)
                rest, block, nth = flat[whole * block_tokens:], block + whole, nth + part.num_rows
        if len(rest):
            yield out(file, [rest.tobytes()], [], id_type, block, nth)

    return store(slim.mapInArrow(run, schema), "flat-tokens")


def blocks_from_files(spark: SparkSession, path: str, token_bytes: int = 2, block_tokens: int = BLOCK_TOKENS,
                      split_blocks: int = SPLIT_BLOCKS) -> DataFrame:
    """(file, block, tokens) of raw token files under ``path``, in fixed-length splits of ``split_blocks`` blocks.

    ``file`` is the path. Spark lists the files without reading them; each split is
    read by a task of its own through pyarrow's file systems, so a file may have any
    length. A file that ends inside a token is an error; an empty one has no blocks.
    """
    step = token_bytes * block_tokens
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    last = F.floor((F.col("length") - 1) / (step * split_blocks)).cast("long")
    splits = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("split"))
    tasks = max(splits.count(), 1)  # a few bytes each: a plain shuffle would merge them into one task

    def run(batches):
        for b in batches:
            for p, length, split in zip(*(b.column(c).to_pylist() for c in ("path", "length", "split"))):
                if length % token_bytes:
                    raise ValueError(f"{p} does not hold a whole number of tokens")
                files, place = filesystem(p)
                with files.open_input_file(place) as f:
                    for block in range(split * split_blocks, min((split + 1) * split_blocks, -(-length // step))):
                        data = f.read_at(min(step, length - block * step), block * step)
                        yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([block], pa.int64()), pa.array([data], pa.binary())],
                                                         names=["file", "block", "tokens"])

    return splits.repartition(min(tasks, 1 << 16)).mapInArrow(run, "file string, block long, tokens binary")


def scan_blocks(blocks: DataFrame, separator: int, dtype: str) -> DataFrame:
    """(file, block, n, seps, head, tail, inner): per block the tokens up to and with the first separator
    (all without one), those after the last, and the lengths, with separator, of documents wholly inside."""
    schema = schema_of(blocks.select("file", "block", *[F.lit(0).cast("long").alias(c) for c in ("n", "seps", "head", "tail")],
                                     F.array(F.lit(0).cast("long")).alias("inner")))

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column("tokens"):
                ids = np.frombuffer(t.as_buffer(), dtype) if t.is_valid else np.zeros(0, dtype)
                at = np.flatnonzero(ids == separator)
                n = len(ids)
                rows.append((n, len(at), at[0] + 1 if len(at) else n, n - at[-1] - 1 if len(at) else n, np.diff(at).tolist()))
            cols = [pa.array([int(r[k]) for r in rows], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), *cols, pa.array([r[4] for r in rows], pa.list_(pa.int64()))],
                                             names=schema.names)

    return blocks.select("file", "block", "tokens").mapInArrow(run, schema)


def _scan(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Exclusive scan in ``order`` within ``by``: (ended) documents ended before, (carry) tokens since the
    last separator or the scan's start, (fresh) whether no separator came before."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy(order)
    rows = (rows.withColumn("ended", F.coalesce(F.sum("seps").over(before), F.lit(0)))
            .withColumn("part", F.sum((F.col("seps") > 0).cast("long")).over(upto)))
    in_part = Window.partitionBy(*by, "part").orderBy(order)
    rows = rows.withColumn("since", F.sum("tail").over(in_part))
    return (rows.withColumn("carry", F.coalesce(F.lag("since").over(upto), F.lit(0)))
            .withColumn("fresh", F.col("ended") == 0).drop("since", "part"))


def prefix_scan(summaries: DataFrame, run: int = RUN) -> DataFrame:
    """``summaries`` with ended and carry for every block, from a scan of blocks in runs and of runs in files."""
    local = _scan(summaries.withColumn("run", F.floor(F.col("block") / run)), ["file", "run"], "block")
    last = F.max(F.struct("block", F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail")).alias("tail")))
    runs = local.groupBy("file", "run").agg(F.sum("seps").alias("seps"), last["tail"].alias("tail"))
    runs = _scan(runs, ["file"], "run").select("file", "run", F.col("ended").alias("run_ended"), F.col("carry").alias("run_carry"))
    return (local.join(runs, ["file", "run"])
            .withColumn("carry", F.col("carry") + F.when(F.col("fresh"), F.col("run_carry")).otherwise(0))
            .withColumn("ended", F.col("ended") + F.col("run_ended")).drop("run_ended", "run_carry", "fresh", "run"))


def count_tokens(blocks: DataFrame, separator: int, dtype: str = "<u2", run: int = RUN) -> DataFrame:
    """One row per document of the flat files: file, nth (from 0), n_tokens without the separator, closed.

    ``blocks`` has (file, block, tokens). A document is what ends at a
    separator; an empty one counts 0. Tokens after a file's last separator form
    one more document with ``closed`` false. An empty file has no documents.
    """
    placed = store(prefix_scan(store(scan_blocks(blocks, separator, dtype), "token-summaries"), run), "token-scan")
    first = F.when(F.col("seps") > 0, F.array(F.col("carry") + F.col("head"))).otherwise(F.array().cast("array<bigint>"))
    docs = placed.select("file", "ended", F.posexplode(F.concat(first, "inner")).alias("k", "length"))
    whole = docs.select("file", (F.col("ended") + F.col("k")).alias("nth"), (F.col("length") - 1).alias("n_tokens"), F.lit(True).alias("closed"))
    end = placed.groupBy("file").agg(F.max(F.struct("block", "ended", "seps", "carry", "tail")).alias("e"))
    left = F.col("e.tail") + F.when(F.col("e.seps") == 0, F.col("e.carry")).otherwise(0)
    rest = end.select("file", (F.col("e.ended") + F.col("e.seps")).alias("nth"), left.alias("n_tokens"), F.lit(False).alias("closed"))
    return whole.unionByName(rest.filter("n_tokens > 0"))
