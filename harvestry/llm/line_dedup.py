"""Incremental, reversible line deduplication.

A line's key is the line stripped of ASCII blanks with A-Z lower-cased; keys of
at least ``MIN_CHARS`` code points count. ``LineIndex`` is one version of the
state, tables in the shared folder:

* ``refs``: (digest, doc), each document's distinct keys - the exact references;
* ``counts``: (shard, digest, n_docs, least) - the exact reference count of each
  key and the smallest document holding it;
* ``filters``: one cuckoo filter per shard, over the digests in ``counts``.

``insert`` and ``delete`` write a new version, so a step can be undone by going
back to the old one, and deleting the documents just inserted gives the same
counts. An insertion folds its lines to one row per key first (a line in a third
of all documents is one row), asks the key's filter, and looks up only the keys
that the filter may know in the exact table; all others are new. Deletions
take keys whose count falls to zero out of the filter. Filters are one Python
group per shard, bounded by the number of keys in a shard, not of lines. There
are as many shards as the keys need at ``SHARD_KEYS`` each, a power of two; an
index that outgrows twice that splits its shards and builds their filters anew
from the exact counts.

Null texts count as empty. Rows that share an id are one document; a null id is
a document of its own kind. Other columns are ignored, whatever their names; an
empty table gives an empty index.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.llm.common import BLANKS, join_hot, lower_ascii, schema_of, store, whole_text
from harvestry.llm.cuckoo import CuckooFilter

MIN_CHARS = 10
#: Keys that one filter is made for; shards follow the number of keys.
SHARD_KEYS = 1 << 18


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def references(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(digest, doc), distinct: the keys long enough of each document."""
    keys = F.transform(F.split(whole_text(text_col), "\n"), line_key)
    long = F.array_distinct(F.filter(keys, lambda k: F.length(k) >= min_chars))
    rows = docs.select(F.col(id_col).alias("doc"), F.explode(long).alias("key"))
    return rows.select(F.unhex(F.sha2("key", 256)).alias("digest"), "doc").distinct()


def _shard(shards: int) -> Column:
    return F.pmod(F.shiftright(F.xxhash64("digest"), 40), F.lit(shards)).cast("long")


def _power(n: float) -> int:
    """The smallest power of two that is at least ``n``."""
    return 1 << max(math.ceil(n) - 1, 0).bit_length()


@dataclass
class LineIndex:
    refs: DataFrame | None = None
    counts: DataFrame | None = None
    filters: DataFrame | None = None
    shards: int | None = None
    min_chars: int = MIN_CHARS
    shard_keys: int = SHARD_KEYS

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The index with ``docs`` too. Inserting a document again changes nothing."""
        new = references(docs, id_col, text_col, self.min_chars)
        if self.refs is not None:
            known = self.refs.withColumnsRenamed({"digest": "_d", "doc": "_doc"})
            new = new.join(known, (F.col("digest") == F.col("_d")) & F.col("doc").eqNullSafe(F.col("_doc")), "left_anti")
        new = store(new, "line-refs")
        per_key = store(new.groupBy("digest").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc").alias("least")), "line-batch")
        grown = self._resharded(per_key.count() + (self.counts.count() if self.counts is not None else 0))
        return grown._add(new, per_key.select(_shard(grown.shards).alias("shard"), "digest", F.xxhash64("digest").alias("h"), "n_docs", "least"))

    def _resharded(self, keys: int) -> LineIndex:
        """This index with shards enough for ``keys``: unchanged while they hold at most twice the keys that they are made for."""
        if self.counts is None:
            return replace(self, shards=self.shards or _power(keys / self.shard_keys))
        if keys <= 2 * self.shards * self.shard_keys:
            return self
        shards = _power(keys / self.shard_keys)
        counts = store(self.counts.withColumn("shard", _shard(shards)), "line-counts")
        return replace(self, counts=counts, filters=self._built(counts), shards=shards)

    def _add(self, new: DataFrame, per_key: DataFrame) -> LineIndex:
        if self.counts is None:
            counts = store(per_key.drop("h"), "line-counts")
            return replace(self, refs=new, counts=counts, filters=self._built(counts))
        asked = store(self._ask(per_key), "line-asked")
        maybe = asked.filter("maybe").select("digest", F.col("n_docs").alias("more"), F.col("least").alias("least2"))
        grown = self.counts.join(maybe, "digest", "left").select(
            "shard", "digest", (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.least("least", "least2").alias("least"))
        mistaken = asked.filter("maybe").join(self.counts.select("digest"), "digest", "left_anti")  # the filter's false positives
        fresh = asked.filter("not maybe").unionByName(mistaken)
        counts = store(grown.unionByName(fresh.select("shard", "digest", "n_docs", "least")), "line-counts")
        filters = self._changed(fresh.select("shard", "h"), counts, deleting=False)
        return replace(self, refs=self.refs.unionByName(new), counts=counts, filters=filters)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """The index without the documents whose ids are in ``ids``; unknown ids are ignored."""
        gone_ids = ids.select(F.col(id_col).alias("_id")).distinct()
        same = F.col("doc").eqNullSafe(F.col("_id"))
        gone = store(self.refs.join(gone_ids, same, "left_semi"), "line-gone")
        refs = store(self.refs.join(gone_ids, same, "left_anti"), "line-refs")
        less = gone.groupBy("digest").agg(F.count(F.lit(1)).alias("less"))
        touched = store(self.counts.join(less, "digest").select("shard", "digest", (F.col("n_docs") - F.col("less")).alias("n_docs")),
                        "line-touched")
        least = refs.join(touched.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.min("doc").alias("least"))
        left = touched.filter("n_docs > 0").join(least, "digest").select("shard", "digest", "n_docs", "least")
        same_counts = self.counts.join(touched.select("digest"), "digest", "left_anti").select("shard", "digest", "n_docs", "least")
        counts = store(same_counts.unionByName(left), "line-counts")
        dead = touched.filter("n_docs = 0").select("shard", F.xxhash64("digest").alias("h"))
        return replace(self, refs=refs, counts=counts, filters=self._changed(dead, counts, deleting=True))

    def repeated(self) -> DataFrame:
        """(doc, digests): for each document the keys of which its lines are dropped."""
        many = self.counts.filter("n_docs > 1").select("digest", "least", "n_docs")
        lost = join_hot(self.refs, many, ["digest"], "n_docs").filter(~F.col("doc").eqNullSafe(F.col("least")))
        return lost.groupBy("doc").agg(F.collect_set("digest").alias("digests"))

    def _built(self, counts: DataFrame) -> DataFrame:
        def build(t: pa.Table) -> pa.Table:
            keys = t.column("h").to_numpy()
            capacity = 2 * len(keys)  # room to grow
            while not (made := CuckooFilter(capacity)).insert(keys):
                capacity *= 2
            return pa.table({"shard": t.column("shard")[:1], "filter": pa.array([made.dump()], pa.binary())})

        hashed = counts.select("shard", F.xxhash64("digest").alias("h"))
        return store(hashed.groupBy("shard").applyInArrow(build, "shard long, filter binary"), "line-filters")

    def _ask(self, per_key: DataFrame) -> DataFrame:
        schema = schema_of(per_key.withColumn("maybe", F.lit(True)))

        def ask(own: pa.Table, keys: pa.Table) -> pa.Table:
            if own.num_rows and keys.num_rows:
                maybe = CuckooFilter.load(own.column("filter")[0].as_py()).contains(keys.column("h").to_numpy())
            else:
                maybe = np.zeros(keys.num_rows, bool)
            return keys.append_column("maybe", pa.array(maybe))

        return self.filters.groupBy("shard").cogroup(per_key.groupBy("shard")).applyInArrow(ask, schema)

    def _changed(self, keys: DataFrame, counts: DataFrame, deleting: bool) -> DataFrame:
        """Filters after inserting or deleting ``keys``; a shard that outgrew its filter is built anew from ``counts``."""
        def change(own: pa.Table, keys: pa.Table) -> pa.Table:
            shard = (own if own.num_rows else keys).column("shard")[:1]
            data = None
            if own.num_rows:
                made, h = CuckooFilter.load(own.column("filter")[0].as_py()), keys.column("h").to_numpy()
                if deleting:
                    made.delete(h)
                    data = made.dump()
                elif made.insert(h):
                    data = made.dump()
            return pa.table({"shard": shard, "filter": pa.array([data], pa.binary())})

        out = store(self.filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(change, "shard long, filter binary"),
                    "line-filters")
        full = out.filter("filter is null").select("shard")
        if full.isEmpty():
            return out
        return store(out.filter("filter is not null").unionByName(self._built(counts.join(full, "shard", "left_semi"))), "line-filters")


def drop_repeated_lines(docs: DataFrame, index: LineIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_lines (before), n_dropped, kept (the text that stays).

    A key held by at least two documents loses all its lines except those of
    the smallest id holding it (null ids lose first). A null or empty text has
    one empty line. Rows sharing an id are one document for counting and each
    give a row.
    """
    lost = index.repeated().withColumnRenamed("doc", "_doc")
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    joined = rows.join(lost, F.col("_id").eqNullSafe(F.col("_doc")), "left").select("_id", "_text", "digests")
    schema = schema_of(joined.select("_id", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"),
                                     F.col("_text").alias("kept")))
    min_chars = index.min_chars

    def digest(line: bytes) -> bytes | None:
        key = line.strip().lower()  # bytes: ASCII blanks and A-Z only
        return hashlib.sha256(key).digest() if len(key) >= min_chars else None

    def run(batches):
        for b in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, digests in zip(b.column("_text"), b.column("digests")):
                text = text.as_py()
                n = text.count("\n") + 1
                if digests.is_valid:
                    gone = set(digests.as_py())
                    stay = [x for x in text.encode().split(b"\n") if digest(x) not in gone]
                    n_dropped.append(n - len(stay))
                    kept.append(b"\n".join(stay).decode())
                else:
                    n_dropped.append(0)
                    kept.append(text)
                n_lines.append(n)
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                                              pa.array(kept, pa.string())], names=["_id", "n_lines", "n_dropped", "kept"])

    return joined.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
