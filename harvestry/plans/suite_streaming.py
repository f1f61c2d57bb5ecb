"""Queries: streaming (T1–T2). The scenario batch is written to a landing
folder, then consumed as a file stream; the answers equal the batch ones."""

from __future__ import annotations

from harvestry.functions.numeric import sql_np_round
from harvestry.operators import scoring as R
from harvestry.operators.validation import sql_condition_reasons
from harvestry.plans.registry import query
from harvestry.plans.suite_quality import requests
from harvestry.plans.suite_scoring import MODEL, _P
from harvestry.session import shared_path
from harvestry.streaming.scoring import stream_decide, stream_score, stream_validate


def _land(df, c, name):
    path = shared_path(c.spark, name)
    df.write.mode("overwrite").parquet(path)
    return path, df.schema


@query("stream_score", f"""
select scenario_id, crop, {sql_np_round(_P, 1)} as predicted_yield_hg_ha, {R.sql_t(_P)} as predicted_yield_t_ha
from valid_scen_crop""", ops="T1 R1")
def q_stream_score(c):
    src, schema = _land(c.scenarios, c, "landing_scenarios")
    return stream_score(c.spark, src, schema, MODEL, shared_path(c.spark, "scored"),
                        shared_path(c.spark, "chk_scored"))


@query("stream_validate", f"""
select scenario_id, crop, {sql_condition_reasons()} as reasons, {sql_condition_reasons()} = '' as accepted
from requests""", ops="T2 Q10")
def q_stream_validate(c):
    src, schema = _land(requests(c), c, "landing_requests")
    out = stream_validate(c.spark, src, schema, shared_path(c.spark, "accepted"), shared_path(c.spark, "rejected"),
                          shared_path(c.spark, "chk_validate"))
    return out.select("scenario_id", "crop", "reasons", "accepted")



def _decided(c):
    src, schema = _land(c.scenarios, c, "landing_decide")
    return stream_decide(c.spark, src, schema, MODEL, shared_path(c.spark, "decided"), shared_path(c.spark, "chk_decided"))


@query("stream_rank", "select * from ranked_crops", ops="W1 R2 T1")
def q_stream_rank(c):
    return _decided(c)[0]


@query("stream_optimize", "select * from opt_best", ops="R3 R4 T1")
def q_stream_optimize(c):
    return _decided(c)[1]
