"""Steps that must not be repeated per level, field or candidate, and give the same rows."""

import json

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from harvestry.functions import domains as D
from harvestry.operators import models as M
from harvestry.operators import scoring as R
from harvestry.sources import fixtures as FX
from harvestry.sources import loaders as L

MODEL = R.LinearModel(FX.coef_rows(), FX.COEF_INTERCEPT)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scaled_variance_is_that_of_the_data(spark):
    """the total variance of scaled data follows from the scaler; a constant feature adds nothing."""
    x = np.random.default_rng(1).normal(size=(40, 4)) * [1.0, 50.0, 0.01, 0.0] + 3.0
    data = spark.createDataFrame([(Vectors.dense(r),) for r in x], ["features"])
    model = M.fit_pca(data, 4)
    z = np.array([r.z.toArray() for r in model.stages[0].transform(data).collect()])
    assert abs(M.scaled_variance(model) - z.var(0, ddof=1).sum()) < 1e-9


def test_fixed_terms_leave_scores_as_they_are(spark):
    """Terms that a swept condition does not change come from before its levels, bit for bit."""
    scenarios = FX.scenario_presets_df(spark)
    names = [f"_p{k}" for k in range(len(D.CROPS))]
    for column, level in (("rainfall_mm", 350.0), ("temperature_celsius", 17.0), ("days_to_harvest", 90.0)):
        fixed = R.with_fixed_terms(scenarios, MODEL, column).withColumn(column, F.lit(level))
        got = R.with_crop_scores(fixed, MODEL, []).select(*names).collect()
        want = R.with_crop_scores(scenarios.withColumn(column, F.lit(level)), MODEL, []).select(*names).collect()
        assert got == want, column


def test_swept_features_are_all_named():
    """A feature that is not named as swept reads the same with another level."""
    for column, swept in R.SWEPT.items():
        for name, e in R.scenario_features(F.lit("Maize")).items():
            assert (column in str(e)) == (name in swept), (column, name)


def test_labels_are_grid_constants(spark):
    """no candidate makes its label as text."""
    curve = R.optimize_curve(FX.scenario_presets_df(spark), MODEL)
    assert "initcap" not in plan(curve)
    assert all(r.config == f"Fert={r.fertilizer_used} / Irri={r.irrigation_used}" for r in curve.collect())


def test_request_is_parsed_once(spark):
    """one parse per request, whatever number of fields is read; a broken request gives no row."""
    rows = FX.scenario_presets_df(spark).select(F.to_json(F.struct("scenario_id", F.struct(*D.CONDITION_COLUMNS).alias("conditions"))).alias("request"))
    out = R.recommend_json(rows.unionByName(spark.createDataFrame([("no json",), (None,)], "request string")), MODEL)
    assert plan(out).count("from_json(") == 1
    found = {r.scenario_id: json.loads(r.response)["rankings"] for r in out.collect()}
    assert len(found) == len(FX.SCENARIO_PRESETS) and all([e["rank"] for e in v] == [1, 2, 3, 4] for v in found.values())


def test_codegen_limit_follows_the_jit():
    """Set where HotSpot would leave large methods to the interpreter, kept where it compiles them or a user has set it."""
    from harvestry.session import JIT_OPTIONS, fit_codegen_to_jit

    class Conf(dict):
        contains = dict.__contains__

    class Session:
        def __init__(self, master, **given):
            self.conf, held = self, Conf(given)
            self.sparkContext, self.changed = self, {}
            self.master, self.getConf = master, lambda: held

        def set(self, k, v):
            self.changed[k] = v

    limit = "spark.sql.codegen.hugeMethodLimit"
    for master, given, want in (("local[2]", {}, {limit: "8000"}), ("yarn", {}, {limit: "8000"}), ("yarn", {limit: "100"}, {}),
                                ("local[2]", {"spark.driver.extraJavaOptions": JIT_OPTIONS}, {}),
                                ("yarn", {"spark.executor.extraJavaOptions": JIT_OPTIONS}, {}),
                                ("yarn", {"spark.driver.extraJavaOptions": JIT_OPTIONS}, {limit: "8000"})):
        s = Session(master, **given)
        fit_codegen_to_jit(s)
        assert s.changed == want, (master, given)


def test_encoding_is_found_without_a_second_parse(spark, tmp_path):
    """F32: the lines tell a file's encoding; the fields are parsed once."""
    (tmp_path / "a.csv").write_bytes("name,n\nCôte,1\n".encode())
    (tmp_path / "b.csv").write_bytes("name,n\nCôte,2\nplain,3\n".encode("latin-1"))
    df = L.read_delimited(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [("Côte", "1"), ("Côte", "2"), ("plain", "3")]
    assert plan(df).count("] csv") == 1 and plan(df).count("] text") == 1


def test_feature_scores_go_by_feature_rows(spark):
    """correlations and information take one aggregate over (feature, value) rows, not one per feature; nulls, constants and empty tables as before."""
    from harvestry.operators import profiling as X

    rng = np.random.default_rng(7)
    rows = [(float(x), 2.0, None if x > 1 else float(x * x), float(y)) for x, y in rng.normal(size=(300, 2))] + [(0.5, 2.0, 0.1, None)]
    names = ["a", "same", "holes"]
    data = spark.createDataFrame(rows, "a double, same double, holes double, t double")
    out = X.corr_with_target(data, names, "t")
    assert plan(out).count("covar_pop(") == 1 and "size(array" not in plan(out)
    got = {r.feature: r.r for r in out.collect()}
    for i, f in enumerate(names):
        if f == "same":
            assert got[f] is None
            continue
        pairs = [(r[i], r[3]) for r in rows if r[i] is not None and r[3] is not None]
        cov = np.cov(np.array(pairs).T, ddof=0)[0, 1]
        sx, sy = (np.std([r[k] for r in rows if r[k] is not None]) for k in (i, 3))
        assert abs(got[f] - cov / (sx * sy)) < 1e-8, f
    mi = {r.feature: r.mi for r in X.mutual_information(data, names, "t").collect()}
    assert mi["same"] == 0.0 and set(mi) == set(names)
    x, y = np.array([(r[0], r[3]) for r in rows if r[3] is not None]).T
    bin_of = lambda v: np.minimum(np.floor((v - v.min()) / (v.max() - v.min()) * 20.0), 19)
    joint = np.histogram2d(bin_of(x), bin_of(y), bins=20, range=[[0, 20], [0, 20]])[0] / len(x)
    full = joint > 0
    assert abs(mi["a"] - (joint * np.log(np.where(full, joint, 1) / np.where(full, np.outer(joint.sum(1), joint.sum(0)), 1)))[full].sum()) < 1e-8
    assert [tuple(r) for r in X.corr_with_target(data.limit(0), names, "t").collect()] == [(f, None, None) for f in names]
    assert X.mutual_information(data.limit(0), names, "t").collect() == []
