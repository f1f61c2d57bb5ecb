import collections
import hashlib

import numpy as np
from pyspark.sql import functions as F

from harvestry.llm import line_dedup as L
from harvestry.llm.cuckoo import CuckooFilter


def lower(s):
    return s.encode().lower().decode()


def brute(rows):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for d, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(d)
    out = []
    for d, text, *_ in rows:
        lines = (text or "").split("\n")
        least = lambda k: min((x for x in holders[k] if x is not None), default=None)
        kept = [x for x in lines if not (len(holders.get(key(x), ())) > 1 and d != least(key(x)))]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def result(docs, index):
    return sorted((tuple(r) for r in L.drop_repeated_lines(docs, index).collect()), key=str)


def state(index):
    return sorted((bytes(r.digest), r.n_docs, r.least) for r in index.counts.collect())


def test_messy_rows_in_any_batches(messy, messy_rows):
    one = L.LineIndex(shards=3).insert(messy)
    assert result(messy, one) == brute(messy_rows)
    odd = F.coalesce(F.col("doc_id") % 2, F.lit(0))
    two = L.LineIndex(shards=3).insert(messy.filter(odd == 1)).insert(messy.filter(odd == 0))
    assert state(two) == state(one) and result(messy, two) == brute(messy_rows)
    assert state(two.insert(messy)) == state(one)  # inserting again changes nothing


def test_deletion_reverses_insertion(messy, messy_rows):
    half = messy.filter("doc_id <= 6")
    before = L.LineIndex(shards=3).insert(half)
    after = before.insert(messy.filter("doc_id > 6 or doc_id is null")).delete(messy.filter("doc_id > 6 or doc_id is null"))
    assert state(after) == state(before)
    rest = L.LineIndex(shards=3).insert(messy).delete(messy.filter("doc_id = 6"))  # the smallest holder goes
    left = [r for r in messy_rows if r[0] != 6]
    assert result(messy.filter("doc_id != 6 or doc_id is null"), rest) == brute(left)


def test_empty(empty, messy):
    index = L.LineIndex().insert(empty)
    assert L.drop_repeated_lines(empty, index).collect() == []
    assert state(index.insert(messy)) == state(L.LineIndex().insert(messy))


def test_cuckoo_filter():
    keys = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 5000)
    f = CuckooFilter(5000)
    assert f.insert(keys) and f.contains(keys).all()
    others = np.random.default_rng(2).integers(-2**63, 2**63 - 1, 20000)
    assert f.contains(others).mean() < 0.01
    g = CuckooFilter.load(f.dump())
    g.delete(keys[:2500])
    assert g.contains(keys[2500:]).all() and g.contains(keys[:2500]).mean() < 0.01
    small = CuckooFilter(10)
    assert not small.insert(keys)


def test_outgrown_filter_is_rebuilt(spark):
    few = spark.range(5).selectExpr("id as doc_id", "concat('a line of its own ', id) as text")
    many = spark.range(5, 3000).selectExpr("id as doc_id", "concat('a line of its own ', id) as text")
    index = L.LineIndex(shards=2).insert(few).insert(many)
    found = {r.shard: CuckooFilter.load(r.filter) for r in index.filters.collect()}
    for r in index.counts.select("shard", F.xxhash64("digest").alias("h")).collect():
        assert found[r.shard].contains(np.array([r.h])).all()


def test_digest_matches_spark(spark):
    k = spark.sql("select unhex(sha2('ab cd ef gh', 256)) as d").first().d
    assert bytes(k) == hashlib.sha256(b"ab cd ef gh").digest()


def test_shards_follow_the_number_of_keys(spark):
    """An index grown batch by batch splits its shards and equals one made at once; its filters know every key."""
    docs = spark.range(60).selectExpr("id as doc_id", "concat('this is line number ', id div 2, '\n', 'and one that all share') as text")
    index, seen = L.LineIndex(shard_keys=4), []
    for k in range(3):
        index = index.insert(docs.filter(f"doc_id % 3 = {k}"))
        seen.append(index.shards)
        assert index._ask(index.counts.withColumn("h", F.xxhash64("digest"))).filter("not maybe").count() == 0
    once = L.LineIndex(shard_keys=4).insert(docs)
    assert seen[0] >= 4 and seen[-1] <= once.shards <= 2 * seen[-1]
    facts = lambda x: sorted((bytes(r.digest).hex(), r.n_docs, r.least) for r in x.counts.collect())
    assert facts(index) == facts(once)
    assert L.LineIndex().insert(docs).shards == 1
    back = index.delete(docs.filter("doc_id % 3 > 0").select("doc_id"))
    assert facts(back) == facts(L.LineIndex().insert(docs.filter("doc_id % 3 = 0")))
