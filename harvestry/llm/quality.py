"""Quality rules with adaptive thresholds, built-in functions only.

Each document gets four measures as integers: symbols per 1000 words, hundredths
of a character per word, repeated lines per 1000 lines, repeated words per 1000
words. Their distribution is kept in a mergeable quantile sketch for each
(language, source): counts of values rounded down to ``KEPT_BITS`` significant
bits, i.e. log-linear bins with a relative error under 2^-(KEPT_BITS-1). Two
sketches merge by adding counts, which is what the partial aggregation does; the
language's sketch and the overall one are merged from the sources' sketches. The
bins are integers, so the sketch does not depend on merge order and reruns agree.

A group's limits are quantiles of its own sketch plus a multiple of its spread and
a small allowance (``RULES``). Where values lie around a centre, the centre is the
median and the spread towards a limit is that of the opposite half, so junk in the
tail does not widen the limit that should reject it. Measures that are zero for
most texts have no such spread; their limit is a multiple of an upper quantile,
chosen by the share of junk that it must not be moved by: 75 % for symbols, whose
junk may be a quarter of a source, 98 % for repeated lines and 95 % for repeated
words, which clean texts have too. Small groups have uncertain quantiles: a
group's limits are the mean of its own and its language's, weighted by its
documents and ``PRIOR``, and a language's likewise with the overall ones, so
verdicts do not jump at a size. The limits are then joined to the measures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from harvestry.llm.common import BLANK_CLASS, store, whole_text, words

KEPT_BITS = 7
#: Documents' worth of the wider group's limits in a group's own.
PRIOR = 200
#: measure -> ((quantile, allowance, (times, quantile, less quantile or None)) above, the same below or None)
RULES = {
    "symbols": ((0, 150, (4, 75, None)), None),
    "word_length": ((50, 100, (4, 50, 10)), (50, 100, (4, 90, 50))),
    "dup_lines": ((0, 100, (4, 98, None)), None),
    "repeats": ((0, 100, (4, 95, None)), None),
}
QUANTILES = (10, 50, 75, 90, 95, 98)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once; a lambda that names a column expression evaluates it for each element."""
    return F.transform(F.array(value), body)[0]


def window_hashes(w: Column, size: int = 5) -> Column:
    hashes = let(w, lambda v: F.transform(F.sequence(F.lit(1), F.size(v) - (size - 1)), lambda i: F.xxhash64(F.slice(v, i, size))))
    return F.when(F.size(w) >= size, hashes).otherwise(F.array().cast("array<bigint>"))


def repeat_words(hashes: Column, size: int = 5) -> Column:
    """Words in windows of ``size`` words that occur twice or more, from the hashes of a text's windows in order.

    Only a text in which two hashes agree sorts them to find which. A window
    that repeats covers its words; each adds what the one before has not covered.
    """
    placed = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    same = lambda p, k, x: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
    again = let(placed, lambda p: F.filter(p, lambda x, k: same(p, k - 1, x) | same(p, k + 1, x)))
    at = F.array_sort(F.transform(again, lambda x: x["i"]))
    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(size), i - acc["last"])).alias("n"), i.alias("last"))
    covered = F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last")), step, lambda acc: acc["n"])
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered)


def with_stats(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` and the columns STATS (long), named with ``prefix``."""
    p, text = prefix, whole_text(text_col)
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    out = (docs.withColumn(f"{p}_w", words(text))
           .withColumn(f"{p}_l", F.filter(F.split(text, "\n"), has_word)))
    w = F.col(f"{p}_w")
    out = out.withColumn(f"{p}_h", window_hashes(w))
    h, lines = F.col(f"{p}_h"), F.col(f"{p}_l")
    stats = {
        "n_words": F.size(w),
        "word_chars": F.length(F.regexp_replace(text, BLANK_CLASS + "+", "")),
        "n_symbols": F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeat_words(h),
        "n_lines": F.size(lines),
    }
    return out.select(*[F.col(c) for c in docs.columns], *[e.cast("long").alias(p + k) for k, e in stats.items()])


def measures(prefix: str = "") -> dict[str, Column]:
    c = lambda k: F.col(prefix + k)
    per = lambda a, b, unit: F.when(c(b) > 0, F.floor(c(a) * unit / c(b))).cast("long")
    return {"symbols": per("n_symbols", "n_words", 1000), "word_length": per("word_chars", "n_words", 100),
            "dup_lines": per("n_dup_lines", "n_lines", 1000), "repeats": per("n_repeat_words", "n_words", 1000)}


def base_failed(prefix: str = "") -> Column:
    return (F.col(prefix + "n_words") < 10) | (100 * F.col(prefix + "n_repeat_words") > 20 * F.col(prefix + "n_words"))


def sketch(stats: DataFrame, groups: list[str], prefix: str = "") -> DataFrame:
    """Mergeable quantile sketch: (groups, measure, bin, n). Documents without a word have no measures."""
    m = measures(prefix)
    long = stats.select(*groups, F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("v")) for k, v in m.items()]))
                        .alias("m")).select(*groups, "m.measure", "m.v").filter("v is not null")
    low_bits = f"greatest(length(bin(v)) - {KEPT_BITS}, 0)"
    return (long.withColumn("bin", F.expr(f"shiftleft(shiftright(v, {low_bits}), {low_bits})"))
            .groupBy(*groups, "measure", "bin").agg(F.count(F.lit(1)).alias("n")))


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    return sketches.groupBy(*groups, "measure", "bin").agg(F.sum("n").alias("n"))


def limits(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, docs, low_<measure>, high_<measure>) from the sketches' quantiles by ``RULES``."""
    by = [*groups, "measure"]
    run = Window.partitionBy(*by).orderBy("bin")
    ranked = sketches.select(*by, "bin", F.sum("n").over(run).alias("below"), F.sum("n").over(Window.partitionBy(*by)).alias("all"))
    q = ranked.groupBy(*by).agg(
        F.max("all").alias("docs"),
        *[F.min(F.when(F.col("below") * 100 >= F.col("all") * p, F.col("bin"))).alias(f"q{p}") for p in QUANTILES])
    at = lambda p: F.col(f"q{p}") if p else F.lit(0)
    wide = []
    for k, sides in RULES.items():
        for side, sign, rule in (("low", -1, sides[1]), ("high", 1, sides[0])):
            if rule:
                centre, allowance, (times, upper, lower) = rule
                limit = at(centre) + sign * (allowance + times * (at(upper) - at(lower or 0)))
                wide.append(F.max(F.when(F.col("measure") == k, limit)).cast("long").alias(f"{side}_{k}"))
            else:
                wide.append(F.lit(None).cast("long").alias(f"{side}_{k}"))
    return q.groupBy(*groups).agg(F.max("docs").alias("docs"), *wide)


def _shrunk(own: Column, docs: Column, wider: Column) -> Column:
    """The mean of a limit and the wider group's, weighted by documents; whole numbers, so reruns and SQL agree."""
    return F.coalesce(F.floor((own * docs + wider * PRIOR) / (docs + PRIOR)).cast("long"), wider)


def adaptive_limits(stats: DataFrame, lang_col: str = "lang", source_col: str = "source", prefix: str = "") -> DataFrame:
    """One row per (lang, source), columns _limit_<side>_<measure>."""
    own = sketch(stats.select(F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"),
                              *[F.col(prefix + s) for s in STATS]), ["_lang", "_source"], prefix)
    own = store(own, "quality-sketch")
    by_lang = merge(own, ["_lang"])
    cols = [f"{side}_{k}" for k in RULES for side in ("low", "high")]
    named = lambda df, tag: df.select(*[F.col(c).alias(c if c.startswith("_") else f"{tag}_{c}") for c in df.columns])
    a, b = named(limits(own, ["_lang", "_source"]), "own"), named(limits(by_lang, ["_lang"]), "lang")
    b = b.withColumnRenamed("_lang", "_lang2")
    overall = limits(merge(by_lang.drop("_lang").withColumn("_all", F.lit(0)), ["_all"]), ["_all"]).select(F.struct(*cols)).scalar()
    # one row per group, one row per language; the overall limits are one value
    joined = a.join(b, F.col("_lang").eqNullSafe(F.col("_lang2")), "left").withColumn("_every", overall)
    pick = [_shrunk(F.col(f"own_{x}"), F.col("own_docs"), _shrunk(F.col(f"lang_{x}"), F.col("lang_docs"), F.col("_every")[x])).alias(f"_limit_{x}")
            for x in cols]
    return store(joined.select("_lang", "_source", *pick), "quality-limits")


def within_limits(prefix: str = "") -> Column:
    ok = F.lit(True)
    for k, v in measures(prefix).items():
        for side, bad in (("high", lambda x, t: x > t), ("low", lambda x, t: x < t)):
            ok = ok & ~F.coalesce(bad(v, F.col(f"_limit_{side}_{k}")), F.lit(False))
    return ok


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                     source_col: str = "source") -> DataFrame:
    """One row per document: id, the counts of STATS, base_failed, kept.

    A null text has no words and fails the base rule. Null languages and sources
    form groups of their own. A document is kept if it passes the base rule and
    every measure lies within its group's limits (a value at the limit does).
    """
    stats = store(with_stats(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                                         F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source")), "_text")
                  .drop("_text"), "quality-stats")
    lim = adaptive_limits(stats, "_lang", "_source").withColumnsRenamed({"_lang": "_l", "_source": "_s"})
    out = stats.join(lim, F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left")
    return out.select(F.col("_id").alias(id_col), *STATS, base_failed().alias("base_failed"),
                      (~base_failed() & within_limits()).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` without the rows that ``quality_verdicts`` rejects, all columns unchanged.

    The measures are computed once for the sketches and again beside the whole
    rows, which costs time but moves no text: the limits are one row per
    (language, source), and only those are joined.
    """
    p = "_q_"
    slim = store(with_stats(docs.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"),
                                        F.col(source_col).alias("_source")), "_text").drop("_text"), "quality-stats")
    lim = adaptive_limits(slim, "_lang", "_source").withColumnsRenamed({"_lang": "_q_l", "_source": "_q_s"})
    full = with_stats(docs, text_col, p)
    good = full.join(lim, F.col(lang_col).eqNullSafe(F.col("_q_l")) & F.col(source_col).eqNullSafe(F.col("_q_s")), "left")
    # one test over columns of both sides: pushed below the join, parts of it would compute the measures once per mention
    bad = F.greatest(base_failed(p).cast("int"), (~within_limits(p)).cast("int"))
    return good.filter(bad == 0).select(*[F.col(c) for c in docs.columns])
