"""Batch what-if scoring over a DataFrame of scenarios.

A model is any object with ``predict(features: dict[str, Column]) -> Column``;
``operators.fitted`` makes one of a saved fitted model.
``LinearModel`` turns a standardised linear model (coefficient table) into one
Catalyst expression; its SQL twin feeds the oracle. The four-crop ranking is
row-local (per-crop columns + ``sort_array``), so it never shuffles; the
60-point grid search is a generator plus a two-phase aggregate whose shuffle
carries one row per scenario.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.functions import domains as D
from harvestry.functions.features import (linear_score, linear_score_sql, serving_feature_columns,
                                          serving_feature_sql)
from harvestry.functions.numeric import case_map, np_round, sql_np_round
from harvestry.operators.joins import crops_array, grid_array
from harvestry.operators.validation import valid_condition


@dataclass
class LinearModel:
    coefs: list[tuple[str, float, float, float]]  # (feature, mean, std, coef) in feature order
    intercept: float

    def predict(self, feats: dict[str, Column], clip: bool = True) -> Column:
        return linear_score(feats, self.coefs, self.intercept, clip)

    def term(self, name: str, x: Column) -> Column | None:
        """One feature's contribution ``coef * (x - mean) / std`` (None if 0)."""
        for f, mean, std, coef in self.coefs:
            if f == name:
                return None if coef == 0.0 else F.lit(float(coef)) * ((x - F.lit(float(mean))) / F.lit(float(std)))
        return None

    def sum_terms(self, terms: dict[str, Column | None], clip: bool = True) -> Column:
        """Intercept plus the given terms, added in feature order (the same
        order as ``predict``, so the result is bit-identical)."""
        acc = F.lit(float(self.intercept))
        for f, _, _, coef in self.coefs:
            t = terms.get(f)
            if coef != 0.0 and t is not None:
                acc = acc + t
        return F.greatest(acc, F.lit(0.0)) if clip else acc

    def predict_sql(self, feats: dict[str, str], clip: bool = True) -> str:
        return linear_score_sql(feats, self.coefs, self.intercept, clip)


def _serving(r, t, d, fert, irri, crop, region, soil, weather):
    return serving_feature_columns(r, t, d, fert, irri, crop, region, soil, weather)


def scenario_features(crop: Column, fert: Column | None = None, irri: Column | None = None,
                      days: Column | None = None) -> dict[str, Column]:
    c = F.col
    return _serving(c("rainfall_mm"), c("temperature_celsius"), days if days is not None else c("days_to_harvest"),
                    fert if fert is not None else c("fertilizer_used"),
                    irri if irri is not None else c("irrigation_used"),
                    crop, c("region"), c("soil_type"), c("weather_condition"))


def scenario_features_sql(crop: str = "crop", fert: str = "fertilizer_used", irri: str = "irrigation_used",
                          days: str = "days_to_harvest") -> dict[str, str]:
    return serving_feature_sql("rainfall_mm", "temperature_celsius", days, fert, irri, crop,
                               "region", "soil_type", "weather_condition")


def hg_to_t(c: Column) -> Column:
    """hg/ha -> t/ha, 3 digits."""
    return np_round(c / F.lit(10000.0), 3)


# ---------------------------------------------------------------------------
# R1 predict
# ---------------------------------------------------------------------------

def predict_yield(scenarios: DataFrame, model, keep: list[str] | None = None) -> DataFrame:
    """Prediction for each (conditions, crop) row; invalid rows are skipped."""
    keep = keep or ["scenario_id", "crop"]
    pred = model.predict(scenario_features(F.col("crop")))
    return (scenarios.where(valid_condition(check_crop=True))
            .select(*keep, pred.alias("_p"))
            .select(*keep, np_round("_p", 1).alias("predicted_yield_hg_ha"), hg_to_t(F.col("_p")).alias("predicted_yield_t_ha")))


# ---------------------------------------------------------------------------
# R2 recommend (rank the four crops)
# ---------------------------------------------------------------------------

CROP_DEPENDENT = {"fao_yield_hg_ha", "water_stress", "heat_stress", "gdd_proxy",
                  *[f"crop_{c}" for c in D.CROPS]}
SHARED_PREFIX = "_cf_"
#: The features that a swept condition changes.
SWEPT = {
    "rainfall_mm": {"rainfall_mm", "rainfall_anomaly", "rainfall_x_fertilizer", "rainfall_x_irrigation", "heat_moisture_ratio",
                    "aridity_index", "harvest_rainfall_rate", "water_stress"},
    "temperature_celsius": {"temperature_celsius", "temp_anomaly", "temp_x_irrigation", "heat_moisture_ratio", "aridity_index",
                            "heat_stress", "gdd_proxy"},
}


def with_crop_scores(df: DataFrame, model, keep: list[str]) -> DataFrame:
    """Adds ``_p0.._p3`` (prediction per crop, clipped) and ``_r0.._r3``
    (rank 1..4 by rounded prediction desc, ties in crop order).

    The crop-independent model terms are projected once as columns; each
    crop's score then adds them in feature order with its own crop-dependent
    terms, so each generated method stays small (JIT-compilable) and the
    result is bit-identical to scoring the full feature vector. Ranks are
    pairwise comparisons of four numbers: no sort, no shuffle. A model without
    terms (fitted trees) scores the four full feature vectors of the row.
    """
    if not hasattr(model, "term"):
        return _with_ranks(df.select(*keep, "rainfall_mm", "temperature_celsius", *[
            model.predict(scenario_features(F.lit(crop))).alias(f"_p{k}") for k, crop in enumerate(D.CROPS)]))
    feats = scenario_features(F.lit(D.CROPS[0]))
    ready = {c for c in df.columns if c.startswith(SHARED_PREFIX)}
    shared = {n: F.col(SHARED_PREFIX + n) if SHARED_PREFIX + n in ready else model.term(n, e)
              for n, e in feats.items() if n not in CROP_DEPENDENT}
    shared = {n: t for n, t in shared.items() if t is not None}
    base = df.select(*keep, "rainfall_mm", "temperature_celsius", "days_to_harvest",
                     *[t.alias(SHARED_PREFIX + n) for n, t in shared.items()],
                     *[c for c in sorted(ready) if c[len(SHARED_PREFIX):] not in feats])
    scores = []
    for k, crop in enumerate(D.CROPS):
        cf = scenario_features(F.lit(crop))
        terms = {n: (F.col(SHARED_PREFIX + n) if n in shared else None) if n not in CROP_DEPENDENT else
                 F.col(f"{SHARED_PREFIX}{n}_{k}") if f"{SHARED_PREFIX}{n}_{k}" in ready else model.term(n, cf[n]) for n in cf}
        scores.append(model.sum_terms(terms))
    return _with_ranks(base.select(*keep, "rainfall_mm", "temperature_celsius", *[p.alias(f"_p{k}") for k, p in enumerate(scores)]))


def with_fixed_terms(df: DataFrame, model, column: str) -> DataFrame:
    """The scoring inputs with the model terms that ``column`` does not change as columns: once per row, before its levels are
    generated. ``with_crop_scores`` adds them in their places, so the result is bit-identical."""
    if not hasattr(model, "term") or column not in SWEPT:
        return df
    shared = {n: model.term(n, e) for n, e in scenario_features(F.lit(D.CROPS[0])).items() if n not in CROP_DEPENDENT | SWEPT[column]}
    by_crop = {f"{n}_{k}": model.term(n, scenario_features(F.lit(crop))[n])
               for n in ("water_stress", "heat_stress", "gdd_proxy") if n not in SWEPT[column] for k, crop in enumerate(D.CROPS)}
    return df.select(*CONDITION_INPUTS, *MANAGEMENT, *[t.alias(SHARED_PREFIX + n) for n, t in (shared | by_crop).items() if t is not None])


def _with_ranks(sc: DataFrame) -> DataFrame:
    # columns of their own, used many times, so that the optimiser leaves them in a step of their own
    sc = sc.select("*", *[np_round(f"_p{k}", 1).alias(f"_q{k}") for k in range(len(D.CROPS))])
    p1 = [F.col(f"_q{k}") for k in range(len(D.CROPS))]
    ranks = []
    for k in range(len(D.CROPS)):
        r = F.lit(1)
        for j in range(len(D.CROPS)):
            if j != k:
                before = (p1[j] > p1[k]) | ((p1[j] == p1[k]) & F.lit(j < k))
                r = r + F.when(before, F.lit(1)).otherwise(F.lit(0))
        ranks.append(r.alias(f"_r{k}"))
    return sc.select("*", *ranks)


def _pick(prefix: str, idx: Column) -> Column:
    return F.element_at(F.array(*[F.col(f"{prefix}{k}") for k in range(len(D.CROPS))]), idx + 1)


def crop_rank_rows(scored: DataFrame, keep: list[str]) -> DataFrame:
    """Four rows per scenario from ``with_crop_scores`` output."""
    ex = scored.select("*", F.explode(F.array(*[F.lit(k) for k in range(len(D.CROPS))])).alias("_ci"))
    crop = F.element_at(F.array(*[F.lit(c) for c in D.CROPS]), F.col("_ci") + 1)
    p = _pick("_p", F.col("_ci"))
    opt = case_map(crop, D.CROP_OPTIMAL_RAINFALL_MM)
    tmax = case_map(crop, D.CROP_MAX_TEMP_C)
    bench = case_map(crop, {k: float(v) for k, v in D.BENCHMARK_YIELD_HG_HA.items()})
    return ex.select(*keep, _pick("_r", F.col("_ci")).cast("int").alias("rank"), crop.alias("crop"),
                     np_round(p, 1).alias("predicted_yield_hg_ha"), hg_to_t(p).alias("predicted_yield_t_ha"),
                     np_round(F.abs(F.col("rainfall_mm") - opt) / opt, 4).alias("water_stress"),
                     np_round(F.greatest(F.col("temperature_celsius") - tmax, F.lit(0.0)), 3).alias("heat_stress"),
                     bench.alias("fao_benchmark_hg_ha"))



def recommend_crops(scenarios: DataFrame, model, keep: list[str] | None = None) -> DataFrame:
    """R2: four rows per valid scenario with ``rank`` 1..4."""
    keep = keep or ["scenario_id"]
    return crop_rank_rows(with_crop_scores(scenarios.where(valid_condition()), model, keep), keep)


def recommend_json(requests_json: DataFrame, model, json_col: str = "request") -> DataFrame:
    """Nested JSON request in, nested JSON ranking out. The ranking is
    an array in the scenario's own row."""
    schema = ("scenario_id string, conditions struct<rainfall_mm:double, temperature_celsius:double, "
              "days_to_harvest:int, region:string, soil_type:string, weather_condition:string, "
              "fertilizer_used:boolean, irrigation_used:boolean>")
    # through a generator: the optimiser would else put one parse of the request in the place of every field
    parsed = requests_json.select(F.inline(F.array(F.from_json(F.col(json_col), schema))))
    flat = parsed.select("scenario_id", "conditions.*").withColumns({
        "fertilizer_used": F.coalesce("fertilizer_used", F.lit(True)),
        "irrigation_used": F.coalesce("irrigation_used", F.lit(True))})
    scored = with_crop_scores(flat.where(valid_condition()), model, ["scenario_id"])

    def entry(k, c):
        opt, tmax = F.lit(D.CROP_OPTIMAL_RAINFALL_MM[c]), F.lit(D.CROP_MAX_TEMP_C[c])
        return F.struct(F.col(f"_r{k}").alias("rank"), F.lit(c).alias("crop"),
                        F.col(f"_q{k}").alias("predicted_yield_hg_ha"),
                        hg_to_t(F.col(f"_p{k}")).alias("predicted_yield_t_ha"),
                        np_round(F.abs(F.col("rainfall_mm") - opt) / opt, 4).alias("water_stress"),
                        np_round(F.greatest(F.col("temperature_celsius") - tmax, F.lit(0.0)), 3).alias("heat_stress"),
                        F.lit(float(D.BENCHMARK_YIELD_HG_HA[c])).alias("fao_benchmark_hg_ha"))

    # through generators: each step's generated code stays below the 8,000 bytes that HotSpot compiles
    scored = scored.select(F.inline(F.array(F.struct("scenario_id", *[entry(k, c).alias(f"_e{k}") for k, c in enumerate(D.CROPS)]))))
    rows = F.array(*[F.col(f"_e{k}") for k in range(len(D.CROPS))])
    return scored.select("scenario_id", F.to_json(F.struct(F.sort_array(rows).alias("rankings"))).alias("response"))


# ---------------------------------------------------------------------------
# R3–R5 optimise management inputs over the 60-point grid
# ---------------------------------------------------------------------------

def optimize_best(scenarios: DataFrame, model, keep: list[str] | None = None) -> DataFrame:
    """Best grid point per (scenario, crop), baseline and gain.

    The grid is a generator (``posexplode`` of a 60-element literal array),
    each candidate's score is code-generated arithmetic, and the arg-max is a
    two-phase ``max`` of one packed long per candidate, whose order is the
    search order: rounded yield (x10, an exact integer) desc, fertiliser on,
    irrigation on, fewer days. The 60 candidates of a scenario are adjacent in
    one task, so the partial aggregate folds them to one row before the
    shuffle, which then carries one row per scenario. Scenarios are grouped
    by a generated row id, so duplicate scenario ids stay separate rows.
    The gain uses the rounded best minus the unrounded baseline, as the
    published engine does.
    """
    keep = keep or ["scenario_id", "crop"]
    carry = ["_rid", *keep, *[c for c in CONDITION_INPUTS if c not in keep], *MANAGEMENT]
    sc = scenarios.where(valid_condition(check_crop=True)).withColumn("_rid", F.monotonically_increasing_id())
    const_terms = {}
    if hasattr(model, "term"):
        # terms that do not depend on the management inputs: once per scenario
        feats = scenario_features(F.col("crop"))
        const_terms = {n: model.term(n, e) for n, e in feats.items() if n not in GRID_DEPENDENT}
        const_terms = {n: t for n, t in const_terms.items() if t is not None}
        sc = sc.select("*", *[t.alias("_gt_" + n) for n, t in const_terms.items()])
    # generator over the 15 day values; the four (fertiliser, irrigation)
    # variants are columns of the same row, reduced with ``greatest``
    g = sc.select(*carry, *["_gt_" + n for n in const_terms],
                  F.posexplode(F.array(*[F.lit(d) for d in D.GRID_DAYS])).alias("_di", "_d"))
    keys = []
    for fert in D.GRID_FERTILIZER:
        for irri in D.GRID_IRRIGATION:
            gfeats = scenario_features(F.col("crop"), fert=F.lit(fert), irri=F.lit(irri), days=F.col("_d"))
            if const_terms:
                p = model.sum_terms({n: (F.col("_gt_" + n) if n in const_terms else model.term(n, gfeats[n]))
                                     for n in gfeats})
            else:
                p = model.predict(gfeats)
            keys.append(F.rint(p * F.lit(10.0)).cast("long") * F.lit(64)
                        + F.lit((32 if fert else 0) + (16 if irri else 0)) + (F.lit(15) - F.col("_di")))
    key = F.greatest(*keys)
    if not const_terms:  # Python scores are made before the aggregate
        g, key = g.select(*carry, key.alias("_k")), F.col("_k")
    best = g.groupBy(*carry).agg(F.max(key).alias("_key"))
    day_idx = F.lit(15) - (F.col("_key") % 16)
    dec = best.select(*carry,
                      ((F.shiftright("_key", 5) % 2) == 1).alias("best_fertilizer_used"),
                      ((F.shiftright("_key", 4) % 2) == 1).alias("best_irrigation_used"),
                      (F.lit(D.GRID_DAYS[0]) + F.lit(D.GRID_DAYS[1] - D.GRID_DAYS[0]) * day_idx).cast("int")
                      .alias("best_days_to_harvest"),
                      (F.shiftright("_key", 6).cast("double") / F.lit(10.0)).alias("best_yield_hg_ha"))
    base = model.predict(scenario_features(F.col("crop")))
    best_p = model.predict(scenario_features(F.col("crop"), fert=F.col("best_fertilizer_used"),
                                             irri=F.col("best_irrigation_used"), days=F.col("best_days_to_harvest")))
    dec = dec.select(*keep, "best_fertilizer_used", "best_irrigation_used", "best_days_to_harvest",
                     "best_yield_hg_ha", best_p.alias("_bp"), base.alias("_base"))
    gain = F.col("best_yield_hg_ha") - F.col("_base")
    return dec.select(
        *keep, "best_fertilizer_used", "best_irrigation_used", "best_days_to_harvest", "best_yield_hg_ha",
        hg_to_t(F.col("_bp")).alias("best_yield_t_ha"),
        np_round("_base", 1).alias("baseline_yield_hg_ha"),
        hg_to_t(F.col("_base")).alias("baseline_yield_t_ha"),
        np_round(gain, 1).alias("yield_gain_hg_ha"),
        F.when(F.col("_base") > 0, np_round(gain / F.col("_base") * F.lit(100.0), 2))
        .otherwise(F.lit(0.0)).alias("yield_gain_pct"),
    )


MANAGEMENT = ["fertilizer_used", "irrigation_used", "days_to_harvest"]
GRID_DEPENDENT = {"fertilizer_used", "irrigation_used", "days_to_harvest", "rainfall_x_fertilizer",
                  "rainfall_x_irrigation", "temp_x_irrigation", "agro_intensity", "harvest_rainfall_rate",
                  "gdd_proxy"}
CONDITION_INPUTS = ["rainfall_mm", "temperature_celsius", "region", "soil_type", "weather_condition"]


def config_label(fert: Column, irri: Column) -> Column:
    """P17: 'Fert=True / Irri=False' (Python capitalisation of booleans)."""
    return F.concat(F.lit("Fert="), F.initcap(fert.cast("string")), F.lit(" / Irri="),
                    F.initcap(irri.cast("string")))


def optimize_curve(scenarios: DataFrame, model, keep: list[str] | None = None) -> DataFrame:
    """Every grid point with its prediction and configuration label.

    Terms that do not depend on the management inputs are projected once per
    scenario before the grid generator, so each grid row only adds its own
    nine terms (same feature order, so bit-identical to the full score)."""
    keep = keep or ["scenario_id", "crop"]
    cols = [*keep, *[c for c in ("crop", "rainfall_mm", "temperature_celsius", "region", "soil_type",
                                 "weather_condition") if c not in keep]]
    valid = scenarios.where(valid_condition(check_crop=True))
    const_terms = {}
    if hasattr(model, "term"):
        feats = scenario_features(F.col("crop"))
        const_terms = {n: model.term(n, e) for n, e in feats.items() if n not in GRID_DEPENDENT}
        const_terms = {n: t for n, t in const_terms.items() if t is not None}
        valid = valid.select(*cols, *[t.alias("_gt_" + n) for n, t in const_terms.items()])
    # the four labels are constants of the grid, not text made for every candidate
    cand = valid.select(*cols, *["_gt_" + n for n in const_terms], F.inline(grid_array(config=config_label)))
    gfeats = scenario_features(F.col("crop"))
    if const_terms:
        p = model.sum_terms({n: (F.col("_gt_" + n) if n in const_terms else model.term(n, gfeats[n]))
                             for n in gfeats})
    else:
        p = model.predict(gfeats)
    return cand.select(*keep, "fertilizer_used", "irrigation_used", "days_to_harvest",
                       "config", np_round(p, 1).alias("predicted_yield_hg_ha"), hg_to_t(p).alias("predicted_yield_t_ha"))


# ---------------------------------------------------------------------------
# R6–R10
# ---------------------------------------------------------------------------

def compare_scenarios(scenarios: DataFrame, model, keep: list[str] | None = None) -> DataFrame:
    """Per scenario the top crop, its yield and the full ranking order."""
    keep = keep or ["scenario_id"]
    sc = with_crop_scores(scenarios.where(valid_condition()), model, keep)
    order = F.sort_array(F.array(*[F.struct(F.col(f"_r{k}").alias("r"), F.lit(c).alias("crop"),
                                            np_round(f"_p{k}", 1).alias("p1")) for k, c in enumerate(D.CROPS)]))
    return sc.select(*keep, order[0]["crop"].alias("top_crop"), order[0]["p1"].alias("top_yield_hg_ha"),
                     F.array_join(F.transform(order, lambda x: x["crop"]), ">").alias("ranking"))


def sensitivity(scenarios: DataFrame, model, column: str, start: float, stop: float, step: float) -> DataFrame:
    """Partial-dependence sweep. For every level of ``column`` and every
    crop, the mean (and range) of the prediction over all scenarios with
    ``column`` set to the level. The levels are a generator; the four crops
    are scored as columns of one row; the aggregate is two-phase, so the
    shuffle carries one row per level and partition. Model terms that the
    column does not change are computed once per scenario."""
    levels = F.sequence(F.lit(start), F.lit(stop), F.lit(step))
    swept = (with_fixed_terms(scenarios.where(valid_condition()), model, column)
             .withColumn(column, F.explode(levels))
             .withColumn(column, F.col(column).cast("double")))
    scored = with_crop_scores(swept, model, [column] if column not in ("rainfall_mm", "temperature_celsius") else [])
    aggs = []
    for k in range(len(D.CROPS)):
        aggs += [F.avg(f"_p{k}").alias(f"m{k}"), F.min(f"_p{k}").alias(f"lo{k}"), F.max(f"_p{k}").alias(f"hi{k}")]
    per = scored.groupBy(column).agg(F.count(F.lit(1)).alias("n_scenarios"), *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("crop"), F.col(f"m{k}").alias("m"), F.col(f"lo{k}").alias("lo"),
                              F.col(f"hi{k}").alias("hi")) for k, c in enumerate(D.CROPS)])
    return per.select(column, "n_scenarios", F.inline(rows)).select(
        column, "crop", np_round("m", 4).alias("mean_predicted_yield_hg_ha"),
        np_round("lo", 4).alias("min_predicted_yield_hg_ha"), np_round("hi", 4).alias("max_predicted_yield_hg_ha"),
        "n_scenarios")


def sensitivity_curve(seasons: DataFrame, model, column: str, start: float, stop: float, step: float,
                      keep: list[str]) -> DataFrame:
    """The curve of each base season: one row per season, level of
    ``column`` and crop, all other conditions as in the season. Row-local."""
    swept = (seasons.where(valid_condition()).withColumn(column, F.explode(F.sequence(F.lit(start), F.lit(stop), F.lit(step))))
             .withColumn(column, F.col(column).cast("double")))
    scored = with_crop_scores(swept, model, keep)
    rows = F.array(*[F.struct(F.lit(c).alias("crop"), F.col(f"_p{k}").alias("p")) for k, c in enumerate(D.CROPS)])
    return scored.select(*keep, column, F.inline(rows)).select(
        *keep, column, "crop", np_round("p", 4).alias("predicted_yield_hg_ha"), hg_to_t(F.col("p")).alias("predicted_yield_t_ha"))


def predict_vs_benchmark(scenarios: DataFrame, model, keep: list[str] | None = None) -> DataFrame:
    """Prediction, benchmark, delta % (1 digit) and t/ha."""
    keep = keep or ["scenario_id", "crop"]
    p = model.predict(scenario_features(F.col("crop")))
    bench = scenario_features(F.col("crop"))["fao_yield_hg_ha"]
    df = scenarios.where(valid_condition(check_crop=True)).select(*keep, np_round(p, 1).alias("p1"), bench.alias("b"))
    return df.select(*keep, F.col("p1").alias("predicted_yield_hg_ha"), F.col("b").alias("fao_benchmark_hg_ha"),
                     np_round((F.col("p1") - F.col("b")) / F.col("b") * F.lit(100.0), 1).alias("delta_pct"),
                     hg_to_t(F.col("p1")).alias("predicted_yield_t_ha"),
                     hg_to_t(F.col("b")).alias("fao_benchmark_t_ha"))


def gain_breakdown(best: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Baseline -> gain -> best as three rows per scenario (``stack``)."""
    keep = keep or ["scenario_id", "crop"]
    return best.select(*keep, F.inline(F.array(
        F.struct(F.lit(1).alias("step_pos"), F.lit("baseline").alias("step"), F.col("baseline_yield_hg_ha").alias("value_hg_ha")),
        F.struct(F.lit(2).alias("step_pos"), F.lit("gain").alias("step"), F.col("yield_gain_hg_ha").alias("value_hg_ha")),
        F.struct(F.lit(3).alias("step_pos"), F.lit("best").alias("step"), F.col("best_yield_hg_ha").alias("value_hg_ha")),
    )))


# ---------------------------------------------------------------------------
# SQL twins for the oracle
# ---------------------------------------------------------------------------

def sql_pred(model: LinearModel, crop: str = "crop", fert="fertilizer_used", irri="irrigation_used",
             days="days_to_harvest") -> str:
    return model.predict_sql(scenario_features_sql(crop, fert, irri, days))


def sql_t(expr: str) -> str:
    return sql_np_round(f"({expr}) / 10000.0e0", 3)
