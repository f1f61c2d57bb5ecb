"""The pipeline's stages against their queries' SQL and brute force on the smallest table."""

import collections

import corpus_pipeline as C
from harvestry.llm import mixing
from harvestry.llm.common import store, table
from harvestry.llm.queries import SQL
from harvestry.plans.oracle import duckdb_connect, run_oracle
from tests.conftest import SF_SMALL
from tests.llm.test_packing import check
from tests.llm.test_simhash import brute, plain


def test_stages(spark):
    con = duckdb_connect(SF_SMALL)
    docs = table(spark, SF_SMALL, "documents")
    stage = dict(C.STAGES)
    assert list(stage) == ["quality rules", "exact dedup", "SimHash near-dedup", "mixing", "packing"]

    good = store(stage["quality rules"](spark, docs, SF_SMALL), "t-good")
    want = run_oracle(con, SQL["op6_quality_rules"])
    assert {r.doc_id for r in good.collect()} == set(want[want.kept].doc_id)

    once = store(stage["exact dedup"](spark, good, SF_SMALL), "t-once")
    con.register("kept_docs", good.toPandas())
    unique = run_oracle(con, SQL["op2_exact_dedup"].replace("from documents", "from kept_docs"))
    assert {r.doc_id for r in once.collect()} == set(unique[unique.kept].doc_id)

    near = store(stage["SimHash near-dedup"](spark, once, SF_SMALL), "t-near")
    rows = once.select("doc_id", "text").collect()
    label = brute([plain(r.text) for r in rows], [r.doc_id for r in rows], 4)
    assert {r.doc_id for r in near.collect()} == set(label)

    mixed = store(stage["mixing"](spark, near, SF_SMALL), "t-mixed")
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter(
        {r.doc_id: r.copies for r in mixing.mix(near).collect() if r.copies})

    packed = stage["packing"](spark, mixed, SF_SMALL).collect()
    texts = collections.defaultdict(list)
    for r in mixed.collect():
        texts[r.doc_id].append(r.text)
    check(packed, texts, 4096)
    for s in (good, once, near, mixed):
        assert s.columns == docs.columns


def test_run_on_an_empty_table(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []


def test_messy_rows_go_through_all_stages(spark, messy_rows, tmp_path):
    """Nulls in every column, repeated rows, empty and long texts: what good, single documents remain is packed whole."""
    spark.createDataFrame([(*r, None) for r in messy_rows], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    rows = C.run(spark, str(tmp_path)).collect()
    assert rows and {r.doc_id for r in rows} <= {r[0] for r in messy_rows if r[1] and len(r[1].split()) >= 10}
    for doc in {r.doc_id for r in rows}:
        assert sum(r.length for r in rows if r.doc_id == doc) % next(r.doc_tokens for r in rows if r.doc_id == doc) == 0
