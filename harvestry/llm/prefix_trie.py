"""Prefix trie of conversations by whole-sequence collapse.

1. ``numbered`` gives every turn its place in its conversation. Turns are range
   partitioned by (conversation, turn), so a conversation of any length is spread
   over tasks; a place is the row number in the partition plus the conversation's
   rows in the partitions before.
2. ``rebuilt`` puts the first turns of a conversation's base in front of its own.
3. A conversation's sequence is the XOR of two 64-bit hashes of (place, role,
   text) over its turns, with its length: equal sequences fold to one weighted
   sequence, represented by its smallest conversation, and the conversations that
   end there become its end list.
4. Only the representatives' prefixes are made: running XORs in blocks of
   ``BLOCK`` turns with the totals of the blocks before. A node is a distinct
   (depth, hashes); its members are the sum of its sequences' weights.
5. Sequences that are proper prefixes of others are dropped by an anti-join; those
   left are the leaves.
6. Each node belongs to the sequence that names it, its smallest one, so each
   sequence owns the lower end of its own path. The sum over a subtree is then the
   sum of what the sequences through its top own, less what the top's owner owns
   above it: one aggregate over the prefixes, never all pairs of ancestors.

Node keys are 128 bits of hash and the depth. Joins that may meet a hot key go
through ``join_hot`` or carry a block number beside the key.

Rows without a conversation id belong to no conversation and give nothing. A null
turn comes first; turns that tie go by the SHA-256 of role, NUL and text, and
repeated rows are turns each. A null role or text is empty. An empty table gives
no nodes, not even a root. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestry.llm.common import join_hot, store

#: Turns of one conversation that one window holds.
BLOCK = 4096
#: Ids that one row of an end list holds at most.
LIST_IDS = 1 << 14
KEY = ["depth", "x1", "x2"]


def _before(order: str, *by: str):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _block(place: Column) -> Column:
    return F.floor((place - 1) / BLOCK).cast("long")


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(part, conv, place from 1, content, bytes): each turn's place in its conversation, its content's hash and its text's bytes."""
    spark = turns.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    slim = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.sha2(F.concat_ws("\0", role, text), 256).alias("content"),
        F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("read"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("content"), F.col("read")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = store(slim.repartitionByRange(n, *order).select(F.spark_partition_id().alias("part"), "*"), "trie-turns")
    here = ranged.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("rows"))
    first = here.select("conv", "part", F.coalesce(F.sum("rows").over(_before("part", "conv")), F.lit(0)).alias("before"))
    row = F.row_number().over(Window.partitionBy("conv", "part").orderBy(F.col("turn").asc_nulls_first(), "content", "read"))
    return ranged.select("conv", "part", "content", "bytes", row.alias("row")).join(first, ["conv", "part"]).select(
        "part", "conv", (F.col("before") + F.col("row")).alias("place"), "content", "bytes")


def rebuilt(turns: DataFrame, base: Column, shared: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) of which each takes the first ``shared`` turns of conversation ``base`` and then its own after as many.

    ``base`` and ``shared`` (at most ``most``) are expressions over column ``conv``;
    ``turns`` is stored output of ``numbered``; the turns returned are (conv, place, content, bytes).
    """
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("turns"))
    convs = sizes.select("conv", base.alias("base"), shared.cast("long").alias("shared"))
    has = sizes.select(F.col("conv").alias("_c"), F.col("turns").alias("base_turns"))
    convs = store(convs.join(has, F.col("base") == F.col("_c"), "left").select(
        "conv", "base", "shared", F.least("shared", F.coalesce("base_turns", F.lit(0))).alias("taken")), "trie-conversations")
    heads = (turns.filter(F.col("place") <= most).withColumnRenamed("conv", "from")
             .join(convs.filter("taken > 0").select("conv", "base", "taken"), (F.col("from") == F.col("base")) & (F.col("place") <= F.col("taken")))
             .select("conv", "place", "content", "bytes"))
    # a long conversation lies in many parts, so its rows are not sent to one task
    parts = turns.select("conv", "part").distinct().join(convs.select("conv", "shared", "taken"), "conv")
    own = (turns.join(parts, ["conv", "part"]).filter(F.col("place") > F.col("shared"))
           .select("conv", (F.col("place") - F.col("shared") + F.col("taken")).alias("place"), "content", "bytes"))
    return convs.select("conv"), heads.unionByName(own)


def _hashes() -> list[Column]:
    return [F.xxhash64(F.lit(k), "place", "content").alias(f"e{k}") for k in (1, 2)]


def collapse(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sequences, ends): one row per distinct sequence (depth, x1, x2, conv: its smallest conversation, weight), and (depth, x1, x2, conv) per conversation."""
    whole = turns.select("conv", *_hashes()).groupBy("conv").agg(F.count(F.lit(1)).alias("depth"), F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"))
    zero = F.lit(0).cast("long")
    ends = store(convs.join(whole, "conv", "left").select(*[F.coalesce(c, zero).alias(c) for c in KEY], "conv"), "trie-ends")
    return store(ends.groupBy(*KEY).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("weight")), "trie-sequences"), ends


def _blocks_of(sequences: DataFrame, *columns: str) -> DataFrame:
    """Each sequence once per block of its turns."""
    return sequences.filter("depth > 0").select("conv", *columns, F.explode(F.sequence(F.lit(0).cast("long"), _block(F.col("depth")))).alias("block"))


def prefixes(sequences: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv, block, length, weight, depth, x1, x2, p1, p2, bytes): the prefixes of each distinct sequence; p1, p2 are the parent's hashes."""
    of = _blocks_of(sequences, F.col("depth").alias("length"), "weight")
    rows = turns.select("conv", F.col("place").alias("depth"), "bytes", *_hashes(), _block(F.col("place")).alias("block")).join(of, ["conv", "block"])
    totals = rows.groupBy("conv", "block").agg(F.bit_xor("e1").alias("t1"), F.bit_xor("e2").alias("t2"))
    zero = F.lit(0).cast("long")
    first = totals.select("conv", "block", *[F.coalesce(F.bit_xor(f"t{k}").over(_before("block", "conv")), zero).alias(f"b{k}") for k in (1, 2)])
    upto = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.bit_xor(f"e{k}").over(upto).alias(f"r{k}") for k in (1, 2)]).join(first, ["conv", "block"])
    x = {k: F.col(f"r{k}").bitwiseXOR(F.col(f"b{k}")) for k in (1, 2)}
    return rows.select("conv", "block", "length", "weight", "depth", *[x[k].alias(f"x{k}") for k in (1, 2)],
                       *[x[k].bitwiseXOR(F.col(f"e{k}")).alias(f"p{k}") for k in (1, 2)], "bytes")


def end_lists(ends: DataFrame) -> DataFrame:
    """(depth, x1, x2, part, nth, ids): the conversations that end at each node in ascending order, as comma-joined text of at most
    ``LIST_IDS`` ids a row; rows of a node in order of (part, nth)."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*KEY, "conv"]
    ranged = ends.select(*keys).repartitionByRange(n, *keys).sortWithinPartitions(*keys).select(F.spark_partition_id().alias("part"), *keys)
    schema = "depth long, x1 long, x2 long, part int, nth long, ids string"
    kinds = [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.string()]

    def run(batches):
        key, ids, nth, rows = None, [], 0, []
        for batch in batches:
            for part, *now, conv in zip(*(batch.column(c).to_pylist() for c in ("part", *keys))):
                if now != key or len(ids) == LIST_IDS:
                    if ids:
                        rows.append((*key, part, nth, ",".join(ids)))
                    nth = nth + 1 if now == key else 0
                    key, ids = now, []
                ids.append(str(conv))
            if len(rows) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[*KEY, "part", "nth", "ids"])
                rows = []
        if ids:
            rows.append((*key, part, nth, ",".join(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[*KEY, "part", "nth", "ids"])

    return ranged.mapInArrow(run, schema)


def list_digests(lists: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256): the SHA-256 of each end list, read row by row in order."""
    order = [*KEY, "part", "nth"]
    ordered = lists.repartition(*KEY).sortWithinPartitions(*order)

    def run(batches):
        key = digest = None
        rows = []
        for batch in batches:
            for *now, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if now != key:
                    if key is not None:
                        rows.append((*key, digest.hexdigest()))
                    key, digest = now, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if len(rows) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 3 + [pa.string()])], names=[*KEY, "ends_sha256"])
                rows = []
        if key is not None:
            rows.append((*key, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 3 + [pa.string()])], names=[*KEY, "ends_sha256"])

    return ordered.mapInArrow(run, "depth long, x1 long, x2 long, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, end lists) of conversations ``convs`` with turns (conv, place from 1 without gaps, content, bytes).

    Nodes are (depth, x1, x2, conv_id, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256); the root has depth 0.
    """
    sequences, ends = collapse(convs, turns)
    paths = store(prefixes(sequences, turns), "trie-prefixes")
    lists = store(end_lists(ends), "trie-end-lists")
    zero = F.lit(0).cast("long")
    nodes = store(paths.groupBy(*KEY).agg(F.min("conv").alias("conv_id"), F.sum("weight").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
                                          ((F.sum("weight") - 1) * F.min("bytes")).alias("saved")), "trie-nodes")
    # leaves: no other sequence has them as a proper prefix; the empty sequence has that of any turn
    inner = paths.filter("depth < length").select(*KEY).distinct()
    leaves = sequences.filter("depth > 0").join(inner, KEY, "left_anti").select(F.col("conv").alias("_leaf"))
    # what each sequence owns: the nodes that it names
    owned = nodes.groupBy(F.col("conv_id").alias("_owner")).agg(F.sum("saved").alias("owned"))
    facts = store(sequences.join(owned, F.col("conv") == F.col("_owner"), "left").join(leaves, F.col("conv") == F.col("_leaf"), "left")
                  .select("conv", "depth", F.coalesce("owned", zero).alias("owned"), F.col("_leaf").isNotNull().cast("long").alias("leaf")), "trie-facts")
    through = (paths.select("conv", "block", *KEY).join(_blocks_of(facts, "owned", "leaf"), ["conv", "block"])
               .groupBy(*KEY).agg(F.sum("owned").alias("through"), F.sum("leaf").alias("n_leaves")))
    # saved by the owner's nodes above each node, in blocks like the prefixes
    mine = nodes.select(*KEY, F.col("conv_id").alias("owner"), "saved", _block(F.col("depth")).alias("block"))
    totals = mine.groupBy("owner", "block").agg(F.sum("saved").alias("t"))
    first = totals.select("owner", "block", F.coalesce(F.sum("t").over(_before("block", "owner")), zero).alias("blocks_before"))
    above = (mine.select("*", F.coalesce(F.sum("saved").over(_before("depth", "owner", "block")), zero).alias("here")).join(first, ["owner", "block"])
             .select(*KEY, (F.col("here") + F.col("blocks_before")).alias("above")))
    children = store(nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2"))
                     .agg(F.count(F.lit(1)).alias("n_children")), "trie-children")
    digests = list_digests(lists)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    full = store(nodes.join(through, KEY).join(above, KEY).join(children, KEY, "left").join(digests, KEY, "left")
                 .select(*KEY, "p1", "p2", "conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
                         (F.col("through") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256")), "trie-full")
    # the root holds every conversation; its row is made of a few sums
    root = sequences.agg(F.min("conv").alias("conv_id"), F.sum("weight").alias("n_convs")).filter("conv_id is not null").select(
        *[zero.alias(c) for c in KEY], "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
        F.coalesce(children.filter("depth = 0").agg(F.sum("n_children")).scalar(), zero).alias("n_children"),
        F.coalesce(facts.agg(F.sum("leaf")).scalar(), zero).alias("n_leaves"), F.coalesce(nodes.agg(F.sum("saved")).scalar(), zero).alias("saved_tokens"),
        F.coalesce(digests.filter("depth = 0").agg(F.min("ends_sha256")).scalar(), nothing).alias("ends_sha256"))
    root = root.withColumn("n_leaves", F.greatest("n_leaves", F.lit(1)))  # childless, it is a leaf itself
    out = root.columns
    parents = full.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"),
                                                   F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    deep = join_hot(full.filter("depth > 1"), parents, ["depth", "p1", "p2"], "siblings").select(*out)
    top = full.filter("depth = 1").withColumn("parent_conv_id", root.select("conv_id").scalar()).select(*out)
    return root.unionByName(top).unionByName(deep), lists


def prefix_trie(turns: DataFrame, every: int = 5, most: int = 8, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, end lists) of the conversations rebuilt on those whose id is a multiple of ``every``.

    Conversation c begins with the first crc32(c) % (most + 1) turns of conversation c - c % every.
    """
    own = store(numbered(turns, conv_col, turn_col, role_col, text_col), "trie-numbered")
    conv = F.col("conv")
    convs, rows = rebuilt(own, conv - conv % every, F.crc32(conv.cast("string").cast("binary")) % (most + 1), most)
    return trie(convs, store(rows, "trie-rebuilt"))
