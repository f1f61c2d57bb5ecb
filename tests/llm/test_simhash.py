import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from harvestry.llm import simhash as S
from tests.llm.conftest import frame, prose


def plain(text, size=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps, ids, bits):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for x, d in zip(label, ids):
        if d is not None:
            least[x] = min(least.get(x, d), d)
    return [least.get(x) for x in label]


def near_copies(rng, n):
    rows, centre = [], prose(rng, 400).split()
    for i in range(n):
        w = list(centre)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "a"))
    return rows + [(n + i, prose(rng, rng.randrange(0, 50)), "en", "b") for i in range(60)]


def test_groups_equal_brute_force(spark, messy_rows):
    rows = near_copies(random.Random(3), 80) + [(None if r[0] is None else r[0] + 1000, *r[1:]) for r in messy_rows]
    want_fp = [plain(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], want_fp, brute(want_fp, [r[0] for r in rows], 4)), key=str)
    for block in (S.BLOCK, 5):  # a tiny block makes every bucket meet in pieces
        got = S.near_groups(frame(spark, rows), block=block).collect()
        assert sorted([(r.id, r.fp % 2**64, r.component) for r in got], key=str) == want


def test_spark_and_python_hash_agree(spark):
    assert spark.sql("select xxhash64('a b c d') as h").first().h % 2**64 == plain("A b C d")


def test_thresholds_satisfy_the_pigeonhole():
    rng = np.random.default_rng(0)
    fps = rng.integers(-2**63, 2**63 - 1, 200)
    for m in (2, 3, 4, 5):
        groups = S.group_bits(np.abs(rng.random((64, 64))), m)
        assert sorted(b for g in groups for b in g) == list(range(64))
        hist = np.stack([np.bincount(S.gather(fps, bits), minlength=256) for _, bits in S.blocks_of(groups)])
        t = S.allocate(fps, groups, S.distance_tables(hist.astype(float), 4), 10**6, 4)
        assert (t >= -1).all() and ((t + 1).sum(1) == 5).all()


def test_matches_equal_all_pairs():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 64, 300).astype(np.int64)
    run, role = np.sort(rng.integers(0, 5, 300)), rng.integers(1, 4, 300)
    u, v = S.matches(run, fps, role, 1, most=50)
    want = {(fps[p], fps[i]) for p in range(300) for i in range(300) if role[p] & 2 and role[i] & 1 and run[p] == run[i]
            and fps[p] != fps[i] and int(fps[p] ^ fps[i]).bit_count() <= 1}
    assert set(zip(u, v)) == want


def test_one_per_group(spark, empty, messy):
    docs = frame(spark, near_copies(random.Random(4), 30))
    groups = S.near_groups(docs).select("component").distinct().count()
    kept = S.one_per_group(docs)
    assert kept.columns == docs.columns and kept.count() == groups
    assert S.near_groups(empty).collect() == [] and S.one_per_group(empty).collect() == []
    assert S.one_per_group(messy).filter("doc_id = 9").count() == 0


def test_many_equal_fingerprints(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same words again and again").alias("text"))
    assert [tuple(r) for r in S.near_groups(docs).groupBy("component").count().collect()] == [(0, 3000)]
