"""Queries: ranking, ordering, sampling, splitting (W2–W4, O1–O9) and set
operations (U1–U2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestry.functions import domains as D
from harvestry.functions.numeric import np_round, sql_np_round
from harvestry.operators import profiling as X
from harvestry.operators import ranking as O
from harvestry.operators.aggregates import pivot_mean
from harvestry.plans.registry import query, view
from harvestry.plans.suite_profiling import CORR_COLS
from harvestry.plans.suite_scoring import MODEL
from harvestry.sources import fixtures as FX

FEATS = D.FEATURES
Y = D.TARGET


def _scores(c):
    """Per-feature scores: |r| with the target, binned MI, |coefficient|."""
    corr = X.corr_with_target(c.features, FEATS, Y).select("feature", "abs_r")
    mi = X.mutual_information(c.features, FEATS, Y)
    coef = c.spark.createDataFrame([(f, abs(k)) for f, _, _, k in MODEL.coefs], "feature string, abs_coef double")
    # all three have one row per feature (36): bounded by the schema
    return corr.join(F.broadcast(mi), "feature").join(F.broadcast(coef), "feature")


view("coef_abs", "select feature, abs(coef) as abs_coef from coef")
view("feature_scores", """
select t.feature, t.abs_r, m.mi, k.abs_coef from corr_target t join mi_scores m on t.feature = m.feature
join coef_abs k on t.feature = k.feature""")


def _avg_rank_sql(col):
    return (f"(rank() over (order by {col} desc) + (count(*) over (partition by {col}) - 1) / 2.0e0)")


@query("mean_rank", f"""
select feature, abs_r, mi, abs_coef, {_avg_rank_sql('abs_r')} as abs_r_rank, {_avg_rank_sql('mi')} as mi_rank,
  {_avg_rank_sql('abs_coef')} as abs_coef_rank,
  ({_avg_rank_sql('abs_r')} + {_avg_rank_sql('mi')} + {_avg_rank_sql('abs_coef')}) / 3.0e0 as mean_rank
from feature_scores""", ops="W2 X15")
def q_mean_rank(c):
    return O.mean_rank(_scores(c), "feature", ["abs_r", "mi", "abs_coef"])


view("var_share", """
with v as (""" + "\nunion all ".join(f"select '{f}' as feature, var_pop({f}) as var from features" for f in FEATS) + """)
select feature, """ + sql_np_round("var / sum(var) over ()", 9) + """ as share from v""")


def _var_share(c):
    from harvestry.operators.aggregates import long_format
    v = long_format(c.features, FEATS, "feature", "value").groupBy("feature").agg(F.var_pop("value").alias("var"))
    tot = v.agg(F.sum("var")).scalar()
    # rounded, so equal-variance features tie exactly and order by name in every engine
    return v.select("feature", np_round(F.col("var") / tot, 9).alias("share"))


@query("cumulative_share", f"""
select feature, {sql_np_round('share', 9)} as share,
  {sql_np_round('sum(share) over (order by share desc, feature rows between unbounded preceding and current row)', 9)}
    as cum_share,
  cast(row_number() over (order by share desc, feature) as int) as k from var_share""", ops="W3")
def q_cumulative_share(c):
    from pyspark.sql import Window
    s = _var_share(c)
    s = s.withColumn("k", F.row_number().over(Window.orderBy(F.desc("share"), "feature")).cast("int"))
    s = O.cumulative_share(s, [F.desc("share"), F.col("feature")], "share")
    return s.select("feature", np_round("share", 9).alias("share"), np_round("cum_share", 9).alias("cum_share"), "k")


@query("components_for", """
with s as (select sum(share) over (order by share desc, feature rows between unbounded preceding and current row)
             as cum_share, row_number() over (order by share desc, feature) as k from var_share)
select cast(min(case when cum_share >= 0.9e0 then k end) as int) as k_90,
  cast(min(case when cum_share >= 0.95e0 then k end) as int) as k_95,
  cast(min(case when cum_share >= 0.99e0 then k end) as int) as k_99 from s""", ops="W4")
def q_components_for(c):
    from pyspark.sql import Window
    s = _var_share(c).withColumn("k", F.row_number().over(Window.orderBy(F.desc("share"), "feature")).cast("int"))
    s = O.cumulative_share(s, [F.desc("share"), F.col("feature")], "share")
    return O.components_for(s, "k", "cum_share", [0.90, 0.95, 0.99])


@query("top_n", "select feature, abs_r from corr_target order by abs_r desc, feature limit 10", ops="O1")
def q_top_n(c):
    t = X.corr_with_target(c.features, FEATS, Y).select("feature", "abs_r")
    return O.top_n(t, 10, [F.desc("abs_r"), F.col("feature")])


@query("top_n_abs", "select feature, r from corr_target order by abs(r) desc, feature limit 10", ops="O2")
def q_top_n_abs(c):
    t = X.corr_with_target(c.features, FEATS, Y).select("feature", "r")
    return O.top_n(t, 10, [F.desc(F.abs("r")), F.col("feature")])


@query("sort_by_row_max", "with p as (select crop, " + ", ".join(
    f"{sql_np_round(f'avg(case when region = {chr(39)}{r}{chr(39)} then yield_hg_ha end)', 4)} as {r}" for r in D.REGIONS)
       + " from merged group by crop)\nselect crop, greatest(" + ", ".join(f"abs({r})" for r in D.REGIONS)
       + ") as row_max, cast(row_number() over (order by greatest(" + ", ".join(f"abs({r})" for r in D.REGIONS)
       + "), crop) as int) as pos from p", ops="O3")
def q_sort_by_row_max(c):
    from pyspark.sql import Window
    p = pivot_mean(c.merged, "crop", "region", D.REGIONS, "yield_hg_ha").withColumn("row_max", O.row_max_abs(D.REGIONS))
    # pivot output has one row per crop (closed domain): a global window is small
    return p.select("crop", "row_max", F.row_number().over(Window.orderBy("row_max", "crop")).cast("int").alias("pos"))


def _corr_sql(a, b):
    return (f"case when stddev_pop(cast({a} as double)) = 0 or stddev_pop(cast({b} as double)) = 0 then null else "
            f"covar_pop(cast({a} as double), cast({b} as double)) / "
            f"(stddev_pop(cast({a} as double)) * stddev_pop(cast({b} as double))) end")


@query("top_by_length", "with a as (" + "\nunion all ".join(
    f"select '{f}' as feature, {sql_np_round(_corr_sql(f, Y), 9)} as x, "
    f"{sql_np_round(_corr_sql(f, 'rainfall_mm'), 9)} as y from features" for f in FEATS)
       + f")\nselect feature, x, y, {sql_np_round('sqrt(x * x + y * y)', 9)} as length from a "
       "where x is not null and y is not null order by length desc, feature limit 14", ops="O4")
def q_top_by_length(c):
    a = X.corr_with_target(c.features, FEATS, Y).select("feature", F.col("r").alias("x"))
    b = X.corr_with_target(c.features, FEATS, "rainfall_mm").select("feature", F.col("r").alias("y"))
    j = a.join(F.broadcast(b), "feature").where(F.col("x").isNotNull() & F.col("y").isNotNull())
    j = j.withColumn("length", np_round(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")), 9))
    return O.top_n(j, 14, [F.desc("length"), F.col("feature")])


def _idxmax_sql(prefix, values):
    cols = [f"{prefix}_{v}" for v in values]
    mx = "greatest(" + ", ".join(cols) + ")"
    return "case " + " ".join(f"when {c} = {mx} then '{v}'" for v, c in zip(values, cols)) + " end"


@query("undo_one_hot", "select " + ", ".join(
    f"{_idxmax_sql(name, dom)} as {name}" for name, dom in D.ONE_HOT_DOMAINS) + " from features", ops="O5")
def q_undo_one_hot(c):
    return c.features.select(*[O.undo_one_hot(name, dom).alias(name) for name, dom in D.ONE_HOT_DOMAINS])


_KEY_SQL = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def _key():
    return F.concat_ws("-", *[F.col(k).cast("string") for k in FX.OBS_KEY])


@query("sample_exact", f"""
select {_KEY_SQL} as k, crop, yield_tons_per_hectare from farm_obs
order by md5({_KEY_SQL} || '42'), {_KEY_SQL} limit 500""", ops="O6")
def q_sample_exact(c):
    d = c.farm_obs.select(_key().alias("k"), "crop", "yield_tons_per_hectare")
    return O.sample_exact(d, 500, F.col("k"), 42)


_HASH_RANK_SQL = f"row_number() over (order by md5({_KEY_SQL} || '42'), {_KEY_SQL})"


@query("train_test_split", f"""
select {_KEY_SQL} as k, {_HASH_RANK_SQL} <= (count(*) over () * 20 + 99) // 100 as is_test from merged_keyed""", ops="O7")
def q_train_test_split(c):
    return c.merged_keyed.select(_key().alias("k"), O.exact_split(c.merged_keyed, _key(), 20, 42).alias("is_test"))


@query("kfold_assign", f"""
with r as (select {_KEY_SQL} as k, {_HASH_RANK_SQL} - 1 as r, count(*) over () // 5 as low, count(*) over () % 5 as longer from merged_keyed)
select k, cast(case when r < (low + 1) * longer then r // (low + 1) else longer + (r - (low + 1) * longer) // low end as int) as fold from r""",
       ops="O8")
def q_kfold_assign(c):
    return c.merged_keyed.select(_key().alias("k"), O.exact_folds(c.merged_keyed, _key(), 5, 42).alias("fold"))


@query("arg_max", """
with m as (select region, crop, avg(yield_hg_ha) as mean_yield from merged group by region, crop)
select region, arg_min(crop, struct_pack(nv := -mean_yield, l := crop)) as crop,
  -min(struct_pack(nv := -mean_yield, l := crop)).nv as mean_yield from m group by region""", ops="O9")
def q_arg_max(c):
    m = c.merged.groupBy("region", "crop").agg(F.avg("yield_hg_ha").alias("mean_yield"))
    return O.arg_max(m, ["region"], "mean_yield", "crop")


@query("category_overlap", """
with a as (select distinct crop from farm_obs where crop is not null),
b as (select distinct crop from lookup_range where crop is not null)
select crop, 'both' as status from (select crop from a intersect select crop from b)
union all select crop, 'left_only' from (select crop from a except select crop from b)
union all select crop, 'right_only' from (select crop from b except select crop from a)""", ops="U1")
def q_category_overlap(c):
    return O.category_overlap(c.farm_obs, c.lookup(FX.YEAR_START, FX.YEAR_END), "crop")


@query("excluded_categories", """
select crop from farm_obs where crop is not null except select crop from lookup_ref""", ops="U2")
def q_excluded_categories(c):
    return O.excluded_categories(c.farm_obs, c.lookup_ref_year, "crop")
