"""Queries: the feature functions."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from harvestry.functions import domains as D
from harvestry.plans.registry import query

GROUPS = {
    "feat_base": ["rainfall_mm", "temperature_celsius", "fertilizer_used", "irrigation_used", "days_to_harvest"],
    "feat_benchmark": ["fao_yield_hg_ha"],
    "feat_anomalies": ["rainfall_anomaly", "temp_anomaly"],
    "feat_interactions": ["rainfall_x_fertilizer", "rainfall_x_irrigation", "temp_x_irrigation", "agro_intensity"],
    "feat_climate": ["heat_moisture_ratio", "aridity_index", "harvest_rainfall_rate"],
    "feat_biology": ["water_stress", "heat_stress", "gdd_proxy"],
    "feat_soil": ["soil_quality_score"],
    "feat_one_hot": D.ONE_HOT_FEATURES,
}
OPS = {"feat_base": "F1 F2", "feat_benchmark": "F3", "feat_anomalies": "F4 F5", "feat_interactions": "F6 F7 F8 F9",
       "feat_climate": "F10 F11 F12", "feat_biology": "F13 F14 F15", "feat_soil": "F16", "feat_one_hot": "F17"}


def _register(name, cols):
    @query(name, "select " + ", ".join(cols) + " from features", ops=OPS[name])
    def _q(c):
        return c.features.select(*cols)
    return _q


for _n, _cols in GROUPS.items():
    _register(_n, _cols)


@query("build_features", "select * from features", ops="F18")
def q_build_features(c):
    return c.features


@query("feature_vector", "select [" + ", ".join(f"cast({f} as double)" for f in D.FEATURES)
       + f"] as features_vec, {D.TARGET} from features", ops="F19 P19")
def q_feature_vector(c):
    va = VectorAssembler(inputCols=D.FEATURES, outputCol="features_vec")
    return va.transform(c.features).select(vector_to_array("features_vec").alias("features_vec"), F.col(D.TARGET))
