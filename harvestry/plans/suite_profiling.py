"""Queries: statistics and profiling (X1–X9, X16) and the SQL-checkable
model metrics (M9 fold metrics of fixed predictions, M10, M16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestry.functions import domains as D
from harvestry.functions.numeric import np_round, sql_hash_bucket, sql_np_round
from harvestry.operators import profiling as X
from harvestry.operators.ranking import fold_id, sample_exact
from harvestry.plans.registry import query, view
from harvestry.plans.suite_scoring import MODEL
from harvestry.sources import fixtures as FX

FEATS = D.FEATURES
Y = D.TARGET


def _safe_corr_sql(a, b):
    return (f"case when stddev_pop({a}) = 0 or stddev_pop({b}) = 0 then null "
            f"else covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) end")


# batch predictions of the reference linear model on the feature table
view("pred_batch", f"select *, {MODEL.predict_sql({f: f for f in FEATS})} as predicted from features")


def pred_batch(c):
    return c.features.withColumn("predicted", MODEL.predict({f: F.col(f) for f in FEATS}))


view("corr_target", "\nunion all ".join(
    f"select '{f}' as feature, {sql_np_round(_safe_corr_sql(f'cast({f} as double)', Y), 9)} as r, "
    f"{sql_np_round('abs(' + _safe_corr_sql(f'cast({f} as double)', Y) + ')', 9)} as abs_r from features" for f in FEATS))


@query("corr_with_target", "select * from corr_target", ops="X1")
def q_corr_with_target(c):
    return X.corr_with_target(c.features, FEATS, Y)


# --- fixed values: columns of the heat map, and the pairs looked at for collinearity
CORR_COLS = ["rainfall_mm", "temperature_celsius", "days_to_harvest", "fertilizer_used", "irrigation_used", "fao_yield_hg_ha",
             "rainfall_anomaly", "temp_anomaly", "rainfall_x_fertilizer", "rainfall_x_irrigation", "agro_intensity",
             "heat_moisture_ratio", "aridity_index", "harvest_rainfall_rate", "water_stress", "heat_stress", "gdd_proxy",
             "soil_quality_score", "yield_hg_ha"]
COLLINEAR = [("rainfall_mm", "rainfall_anomaly"), ("temperature_celsius", "temp_anomaly"),
             ("rainfall_mm", "rainfall_x_fertilizer"), ("rainfall_mm", "aridity_index"), ("agro_intensity", "rainfall_x_fertilizer")]
_PAIRS = [(a, b) for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]]
view("corr_pairs", "\nunion all ".join(
    f"select '{a}' as feature_a, '{b}' as feature_b, "
    f"{sql_np_round(_safe_corr_sql(f'cast({a} as double)', f'cast({b} as double)'), 9)} as r from features"
    for a, b in _PAIRS))


@query("corr_matrix", "select * from corr_pairs", ops="X2")
def q_corr_matrix(c):
    return X.corr_matrix(c.features, CORR_COLS)


@query("collinear_pairs", "\nunion all ".join(
    f"select '{a}' as feature_a, '{b}' as feature_b, r, case when abs(r) > 0.999 then 'PERFECT' when abs(r) > 0.9 then 'HIGH' "
    f"else '' end as flag from (select {sql_np_round(_safe_corr_sql(f'cast({a} as double)', f'cast({b} as double)'), 9)} as r from features)"
    for a, b in COLLINEAR), ops="X3")
def q_collinear_pairs(c):
    return X.collinear_pairs(c.features, COLLINEAR)


@query("corr_bands", """
select *, case when abs_r >= 0.5 then 'strong' when abs_r >= 0.2 then 'moderate' else 'weak' end as band
from corr_target""", ops="X4")
def q_corr_bands(c):
    return X.corr_bands(X.corr_with_target(c.features, FEATS, Y))


def _mi_sql(bins=20):
    unpiv = "\nunion all ".join(f"select '{f}' as feature, cast({f} as double) as value, "
                                f"cast({Y} as double) as y from features" for f in FEATS)

    def b(v, lo, hi):
        return (f"cast(case when {hi} = {lo} then 0 else least(floor(({v} - {lo}) / ({hi} - {lo}) * {bins}.0e0), "
                f"{bins - 1}) end as int)")
    return f"""
with lf as ({unpiv}),
rng as (select feature, min(value) as lo, max(value) as hi, min(y) as ylo, max(y) as yhi from lf group by feature),
bn as (select lf.feature, {b('lf.value', 'rng.lo', 'rng.hi')} as bx, {b('lf.y', 'rng.ylo', 'rng.yhi')} as by_
       from lf join rng on lf.feature = rng.feature where lf.value is not null and lf.y is not null),
j as (select feature, bx, by_, count(*) as nxy from bn group by 1, 2, 3),
m as (select *, sum(nxy) over (partition by feature) as n, sum(nxy) over (partition by feature, bx) as nx,
      sum(nxy) over (partition by feature, by_) as ny from j)
select feature, {sql_np_round('sum((nxy / n) * ln((nxy * n) / (nx * ny)))', 9)} as mi from m group by feature"""


view("mi_scores", _mi_sql())


@query("mutual_information", "select * from mi_scores", ops="X5")
def q_mutual_information(c):
    return X.mutual_information(c.features, FEATS, Y)


@query("residual_summary", f"""
with r as (select {Y} - predicted as residual from pred_batch)
select {sql_np_round('avg(residual)', 6)} as mean, {sql_np_round('stddev_pop(residual)', 6)} as std,
  {sql_np_round('quantile_cont(residual, 0.05)', 6)} as p05, {sql_np_round('quantile_cont(residual, 0.95)', 6)} as p95,
  {sql_np_round('max(abs(residual))', 6)} as max_abs from r""", ops="X6")
def q_residual_summary(c):
    return X.residual_summary(pred_batch(c), Y, "predicted")


@query("histogram", f"""
with s as (select min(yield_hg_ha) as lo, max(yield_hg_ha) as hi from merged),
b as (select cast(case when s.hi = s.lo then 0 else least(floor((m.yield_hg_ha - s.lo) / (s.hi - s.lo) * 40.0e0), 39) end as int) as bin
      from merged m, s where m.yield_hg_ha is not null)
select b.bin, s.lo + b.bin * ((s.hi - s.lo) / 40.0e0) as "left", s.lo + (b.bin + 1) * ((s.hi - s.lo) / 40.0e0) as "right",
  count(*) as n from b, s group by b.bin, s.lo, s.hi""", ops="X7")
def q_histogram(c):
    return X.histogram(c.merged, "yield_hg_ha", 40)


@query("boxplot_stats", f"""
with q as (select crop, quantile_cont(yield_hg_ha, 0.25) as q1, quantile_cont(yield_hg_ha, 0.5) as median,
             quantile_cont(yield_hg_ha, 0.75) as q3 from merged group by crop),
w as (select m.crop, min(case when m.yield_hg_ha >= q.q1 - 1.5e0 * (q.q3 - q.q1) then m.yield_hg_ha end) as whisker_lo,
        max(case when m.yield_hg_ha <= q.q3 + 1.5e0 * (q.q3 - q.q1) then m.yield_hg_ha end) as whisker_hi
      from merged m join q on m.crop = q.crop group by m.crop)
select q.crop, {sql_np_round('q.q1', 6)} as q1, {sql_np_round('q.median', 6)} as median, {sql_np_round('q.q3', 6)} as q3,
  {sql_np_round('q.q3 - q.q1', 6)} as iqr, w.whisker_lo, w.whisker_hi from q join w on q.crop = w.crop""", ops="X8")
def q_boxplot_stats(c):
    return X.boxplot_stats(c.merged, ["crop"], "yield_hg_ha")


STD_COLS = ["rainfall_mm", "temperature_celsius", "days_to_harvest", "fao_pesticides_tonnes"]


@query("standardize", "with s as (select " + ", ".join(
    f"avg({x}) as m_{x}, stddev_pop({x}) as s_{x}" for x in STD_COLS) + " from merged)\nselect crop, " + ", ".join(
    f"{sql_np_round(f'({x} - m_{x}) / case when s_{x} = 0 then 1.0e0 else s_{x} end', 6)} as {x}" for x in STD_COLS)
       + " from merged, s", ops="X9")
def q_standardize(c):
    return X.standardize(c.merged, STD_COLS, keep=["crop"], digits=6)


@query("scatter_extract", f"""
with p as (select *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as k from pred_key)
select k, yield_hg_ha, {sql_np_round('predicted', 6)} as predicted,
  (select {sql_np_round(_safe_corr_sql('yield_hg_ha', 'predicted'), 9)} from pred_key) as r
from p order by md5(k || '42'), k limit 1000""", ops="X16 O6")
def q_scatter_extract(c):
    p = pred_key(c)
    k = F.concat_ws("-", *[F.col(x).cast("string") for x in FX.OBS_KEY])
    r = p.agg(np_round(X.safe_corr(F.col(Y), F.col("predicted")), 9)).scalar()
    s = sample_exact(p.withColumn("k", k), 1000, F.col("k"), 42)
    return s.select("k", Y, np_round("predicted", 6).alias("predicted"), r.alias("r"))


# predictions with the merged row's descriptive columns (for keyed samples / folds)
_KEY_COLS = FX.OBS_KEY + ["crop", "region", "yield_hg_ha"]
from harvestry.functions.features import merged_feature_sql  # noqa: E402

_FS = merged_feature_sql()
view("pred_key", "select " + ", ".join(_KEY_COLS) + f", {MODEL.predict_sql(_FS)} as predicted from merged_keyed")


def pred_key(c):
    from harvestry.functions.features import merged_feature_columns
    return c.merged_keyed.select(*_KEY_COLS, MODEL.predict(merged_feature_columns()).alias("predicted"))


@query("regression_metrics", f"""
select {sql_np_round(f'sqrt(avg(({Y} - predicted) * ({Y} - predicted)))', 6)} as rmse,
  {sql_np_round(f'avg(abs({Y} - predicted))', 6)} as mae,
  {sql_np_round(f'1.0e0 - avg(({Y} - predicted) * ({Y} - predicted)) / var_pop({Y})', 6)} as r2,
  {sql_np_round(f'avg(case when {Y} > 0 then abs(({Y} - predicted) / {Y}) end) * 100.0e0', 6)} as mape,
  count(*) as n from pred_batch""", ops="M10")
def q_regression_metrics(c):
    return X.regression_metrics(pred_batch(c), Y, "predicted")


@query("relative_error", f"""
select crop, {sql_np_round(f'sqrt(avg(({Y} - predicted) * ({Y} - predicted))) / avg({Y}) * 100.0e0', 4)} as rmse_pct_of_mean
from pred_key group by crop""", ops="M16")
def q_relative_error(c):
    e = F.col(Y) - F.col("predicted")
    return pred_key(c).groupBy("crop").agg(
        np_round(F.sqrt(F.avg(e * e)) / F.avg(Y) * F.lit(100.0), 4).alias("rmse_pct_of_mean"))


@query("kfold_metrics", f"""
with f as (select cast({sql_hash_bucket("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) || '42'", 5)} as int) as fold,
             {Y} as y, predicted from pred_key),
m as (select fold, sqrt(avg((y - predicted) * (y - predicted))) as rmse from f group by fold)
select {sql_np_round('avg(rmse)', 6)} as cv_rmse_mean, {sql_np_round('stddev_pop(rmse)', 6)} as cv_rmse_std,
  count(*) as n_folds from m""", ops="M9 O8")
def q_kfold_metrics(c):
    p = pred_key(c)
    k = F.concat_ws("-", *[F.col(x).cast("string") for x in FX.OBS_KEY])
    e = F.col(Y) - F.col("predicted")
    per = p.withColumn("fold", fold_id(k, 5, 42)).groupBy("fold").agg(F.sqrt(F.avg(e * e)).alias("rmse"))
    return per.agg(np_round(F.avg("rmse"), 6).alias("cv_rmse_mean"), np_round(F.stddev_pop("rmse"), 6).alias("cv_rmse_std"),
                   F.count(F.lit(1)).alias("n_folds"))
