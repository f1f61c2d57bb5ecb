"""Ranking and grid search on streams: equal to the batch answers, whatever is replayed."""

import os

import pytest

from harvestry.operators import scoring as R
from harvestry.plans.catalog import Catalog
from harvestry.plans.suite_scoring import MODEL
from harvestry.session import shared_path
from harvestry.streaming.scoring import stream_decide
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def landed(spark):
    path = shared_path(spark, "stream-in")
    Catalog(spark, SF_SMALL).scenarios.repartition(4).write.parquet(path)
    return path, spark.read.parquet(path)


def same(a, b):
    cols = sorted(a.columns)
    return sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


def test_equals_batch_and_a_replay_doubles_nothing(spark, landed):
    path, rows = landed
    sink, checkpoint = shared_path(spark, "stream-out"), shared_path(spark, "stream-chk")
    rankings, best = stream_decide(spark, path, rows.schema, MODEL, sink, checkpoint, files_per_batch=1)
    local = checkpoint.removeprefix("file://")
    commits = sorted(int(f) for f in os.listdir(f"{local}/commits") if f.isdigit())
    assert len(commits) >= 4
    plain_rank, plain_best = R.recommend_crops(rows, MODEL), R.optimize_best(rows, MODEL)
    assert same(rankings, plain_rank) and same(best, plain_best)
    # as if the last batch's sinks were written and the driver lost before the commit
    for f in (f"{commits[-1]}", f".{commits[-1]}.crc"):
        os.remove(f"{local}/commits/{f}")
    rankings, best = stream_decide(spark, path, rows.schema, MODEL, sink, checkpoint, files_per_batch=1)
    assert os.path.exists(f"{local}/commits/{commits[-1]}")
    assert same(rankings, plain_rank) and same(best, plain_best)


def test_new_files_are_added_and_an_empty_source_gives_nothing(spark, landed):
    _, rows = landed
    src, sink, checkpoint = (shared_path(spark, f"stream-{x}") for x in ("src", "sink", "chk"))
    rows.limit(0).write.parquet(src)
    rankings, best = stream_decide(spark, src, rows.schema, MODEL, sink, checkpoint)
    assert rankings.count() == 0 == best.count()
    some = rows.orderBy("scenario_id", "crop").limit(40)
    some.write.mode("append").parquet(src)
    rankings, _ = stream_decide(spark, src, rows.schema, MODEL, sink, checkpoint)
    assert same(rankings, R.recommend_crops(some, MODEL))


def test_a_batch_is_not_kept_in_memory(spark, landed, monkeypatch):
    """Each sink reads the batch's files; no row of a batch is cached for the other sink."""
    from harvestry.streaming import scoring as S

    seen = []

    def ranked(df, model, keep):
        seen.append(df.storageLevel.useMemory or df.storageLevel.useDisk)
        return R.recommend_crops(df, model, keep)

    monkeypatch.setattr(S, "recommend_crops", ranked)
    path, rows = landed
    S.stream_decide(spark, path, rows.schema, MODEL, shared_path(spark, "stream-out"), shared_path(spark, "stream-chk"))
    assert seen and not any(seen)
