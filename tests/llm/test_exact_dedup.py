import collections
import re

from pyspark.sql import functions as F

from harvestry.llm import exact_dedup as E
from harvestry.session import shared_path


def expected(rows):
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append((-len(r[1] or ""), r[0] is None, r[0] or 0, i))
    out = []
    for i, r in enumerate(rows):
        g = groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")]
        out.append((r[0], rows[min(g)[3]][0], len(g)))
    return sorted(out, key=str)


def result(df):
    rows = df.select("id", "keep_id", "group_size", "kept").collect()
    return sorted([tuple(r)[:3] for r in rows], key=str), sum(r.kept for r in rows)


def test_messy_rows(messy, messy_rows):
    got, kept = result(E.exact_groups(messy))
    want = expected(messy_rows)
    assert got == want
    assert kept == len({re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in messy_rows})


def test_colliding_digests_keep_texts_apart(messy, messy_rows):
    """With a four-bit digest nearly every group holds different texts; the byte check must part them."""
    weak = lambda norm: F.substring(F.sha2(norm, 256), 1, 1)
    assert result(E.exact_groups(messy, digest=weak))[0] == expected(messy_rows)


def test_large_group_is_salted(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    got, kept = result(E.exact_groups(docs))
    assert kept == 1 and {g[1:] for g in got} == {(0, 500)}


def test_empty(empty):
    assert E.exact_groups(empty).collect() == []
    assert E.deduplicate(empty).collect() == []


def test_state_goes_on(spark, messy):
    """A second run over new index files adds to the kept state."""
    index, state = shared_path(spark, "t-index"), shared_path(spark, "t-state")
    docs = E.located(messy)
    batch = E.content_index(docs, E.sha256_digest, "doc_id", "text")
    for _ in range(2):
        batch.write.mode("append").parquet(index)
        table = E.stream_state(spark, index, batch.schema, state)
    assert table.agg(F.sum("rows")).first()[0] == 2 * messy.count()


def _runs(spark, rows, digest=E.sha256_digest, cuts=(5, 9)):
    """The rows added in three runs on one state, each from a file of its own; the last run's result."""
    from tests.llm.conftest import frame
    state, at = shared_path(spark, "t-runs"), 0
    for k, end in enumerate([*cuts, len(rows)]):
        path = shared_path(spark, "t-part")
        frame(spark, rows[at:end]).coalesce(1).write.parquet(path)
        got = E.exact_groups(spark.read.parquet(path), digest=digest, state_dir=state, run_id=f"r{k}")
        assert got.count() == end
        at = end
    again = E.exact_groups(spark.read.parquet(path), digest=digest, state_dir=state, run_id=f"r{k}")
    return got, again


def _facts(df):
    rows = df.select("id", "keep_id", "group_size", "kept").collect()
    return sorted([tuple(r)[:3] for r in rows], key=str), sum(r.kept for r in rows)


def test_runs_on_one_state(spark, messy_rows):
    """Three runs give what one run over all rows gives; rows of earlier runs lose their place to longer ones; a repeated call adds nothing."""
    got, again = _runs(spark, messy_rows)
    assert _facts(got)[0] == expected(messy_rows) == _facts(again)[0]
    assert _facts(got)[1] == len({re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in messy_rows})
    lost = got.filter("run = 'r0' and not kept")
    assert lost.count() > 0


def test_bytes_are_checked_across_runs(spark, messy_rows):
    """With a four-bit digest rows of different runs collide; texts are still kept apart."""
    weak = lambda norm: F.substring(F.sha2(norm, 256), 1, 1)
    got, again = _runs(spark, messy_rows, weak)
    assert _facts(got)[0] == expected(messy_rows) == _facts(again)[0]


def test_deduplicate_keeps_columns(messy):
    out = E.deduplicate(messy)
    assert out.columns == messy.columns and out.filter("doc_id = 9").count() == 0 and out.filter("doc_id = 1").count() == 1
