"""Mixing sources to target weights by hash thresholds.

Every document has a 60-bit hash of its id. For each source the words are summed
by the top 15 bits of the hash; a running sum over the buckets finds the one in
which the source's remaining budget ends. Only that bucket is refined by the
next 15 bits, and so on: four nested levels give the hash at which the budget is
spent. A document is then taken by comparing its hash with its source's
threshold, so the rows are never sorted. Budgets above the source's size take
every document whole times first; the threshold spends the remainder.

The document at a threshold seldom fits what is left of the budget, and in a
small source it may be a good part of it. Two more rounds spend the rest in the
same way among the documents beyond the threshold that are no larger than the
rest, each with a threshold of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from harvestry.llm.common import store, whole_text, words

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
LEVELS, BITS = 4, 15
ROUNDS = 3


def hash60(key: Column) -> Column:
    """The first 60 bits of the MD5 of the id's decimal text; a null id hashes the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), hash60(F.col(id_col)).alias("h"),
                       F.size(words(whole_text(text_col))).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: source_size, target.

    Sources in code-point order, null last, get the weights in turn. Targets
    share the whole size by weight and stop at ``max_repeats`` times the
    source's size; the excess goes to the others by weight. That is the level L
    at which sum(min(L * weight, cap)) equals the total: with the sources in
    order of cap / weight, the first k that are capped are those whose ratio
    lies below the level left for the rest. The windows run over one row per
    source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1)
    per = per.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
    everything = Window.partitionBy(F.lit(0))
    by_ratio = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    per = (per.withColumn("total", F.sum("source_size").over(everything).cast("double"))
           .withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
           .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
           .withColumn("level_here", (F.col("total") - F.col("capped_before")) / F.col("weight_left")))
    open_ = F.col("level_here") * F.col("weight") <= F.col("cap")
    per = per.withColumn("level", F.max(F.when(open_, F.col("level_here"))).over(everything))
    target = F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap"))
    return per.select("source", "source_size", target.alias("target"))


def _spend(sized: DataFrame, state: DataFrame, allowed: Column, name: str, levels: int, bits: int) -> DataFrame:
    """``state`` (one row per source) with prefix, the hash at which its budget ends among the ``allowed`` documents,
    budget, what is left of it, and edge, the words at that hash (null if all documents fit)."""
    state = state.withColumn("prefix", F.lit(0).cast("long")).withColumn("edge", F.lit(None).cast("long"))
    of_state = [c for c in state.columns if c not in ("prefix", "edge", "budget")]
    for level in range(levels):
        shift = bits * (levels - 1 - level)
        inside = sized.join(state.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        inside = inside.filter(allowed & (F.shiftright("h", shift + bits) == F.col("prefix")))
        hist = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("bucket")
        hist = hist.select(F.col("source").alias("_h"), "bucket", "words", F.sum("words").over(run).alias("upto"))
        cut = (state.join(hist, F.col("source").eqNullSafe(F.col("_h"))).filter(F.col("upto") > F.col("budget")).groupBy("_h")
               .agg(F.min(F.struct("bucket", "words", (F.col("budget") - (F.col("upto") - F.col("words"))).alias("left"))).alias("cut")))
        # no bucket ends beyond the budget: all that is inside is taken
        state = store(
            state.join(cut, F.col("source").eqNullSafe(F.col("_h")), "left")
            .select(*of_state, F.coalesce("cut.left", "budget").alias("budget"),
                    F.coalesce("cut.bucket", F.shiftleft(F.col("prefix") + 1, bits)).alias("prefix"),
                    F.col("cut.words").alias("edge")), f"mix-{name}-{level}")
    return state


def thresholds(sized: DataFrame, wanted: DataFrame, levels: int = LEVELS, bits: int = BITS, rounds: int = ROUNDS) -> DataFrame:
    """One row per source: source_size, target, repeats (whole times), and for each round the hash below which a document
    that it may take is taken once more (below0, ...), and the size up to which the next round may take one (gap0, ...)."""
    size = F.greatest(F.col("source_size"), F.lit(1)).cast("double")
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    state = wanted.select("source", "source_size", "target", repeats.alias("repeats"),
                          (F.col("target") - repeats * F.col("source_size")).alias("budget"))
    state = store(state, "mix-budget")
    for r in range(rounds):
        state = _spend(sized, state, may_take(r), f"round{r}", levels, bits)
        below = F.col("prefix")
        if r == rounds - 1:  # the documents at the last threshold share one hash: taken if that comes nearer to the budget
            below = below + (F.col("edge").isNotNull() & (F.col("edge") <= 2 * F.col("budget"))).cast("long")
        state = state.withColumn(f"below{r}", below).withColumn(f"gap{r}", F.col("budget")).drop("prefix", "edge")
    return state.withColumnRenamed("source", "_t").drop("budget")


def may_take(r: int) -> Column:
    """Whether round ``r`` may take a document: beyond the last threshold and no larger than what is left."""
    return F.lit(True) if r == 0 else (F.col("h") >= F.col(f"below{r - 1}")) & (F.col("size") <= F.col(f"gap{r - 1}"))


def copies(rounds: int = ROUNDS) -> Column:
    """How often a document (h, size) is taken, beside its source's row of ``thresholds``."""
    once = F.lit(False)
    for r in range(rounds):
        once = once | (may_take(r) & (F.col("h") < F.col(f"below{r}")))
    return F.col("repeats") + once.cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, size, source_size, target, copies, taken (= copies * size).

    A null text has size 0; a null source is a source. Rows that share an id
    share its hash and are taken together. A source whose size is 0 has target
    0. Reruns agree, as the hash depends on the id alone.
    """
    sized = store(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    cuts = thresholds(sized, targets(sized, weights, max_repeats))
    taken = F.least(copies(), F.lit(max_repeats))
    return (sized.join(cuts, F.col("source").eqNullSafe(F.col("_t")))
            .select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("copies"),
                    (taken * F.col("size")).alias("taken")))


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, id_col: str = "doc_id",
              text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it (rows not taken go), columns unchanged."""
    sized = store(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    cuts = thresholds(sized, targets(sized, weights, max_repeats)).drop("source_size", "target")
    cuts = cuts.withColumnsRenamed({c: f"_mix_{c}" for c in cuts.columns})
    text_size = F.size(words(whole_text(text_col))).cast("long")
    row = F.struct(hash60(F.col(id_col)).alias("h"), text_size.alias("size"))
    joined = docs.withColumn("_mix_row", row).join(cuts, F.col(source_col).eqNullSafe(F.col("_mix__t")))
    # ``copies`` reads its columns by name: they are named apart from those of ``docs`` until then
    plain = joined.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_doc"), "_mix_row.*",
                          *[F.col(c).alias(c.removeprefix("_mix_")) for c in cuts.columns])
    times = F.least(copies(), F.lit(max_repeats)).cast("int")
    return (plain.filter(times > 0).select("_doc", F.explode(F.array_repeat(F.lit(1), times)).alias("_copy")).select("_doc.*"))
