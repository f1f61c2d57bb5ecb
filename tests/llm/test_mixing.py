import collections
import random

from harvestry.llm import mixing as M
from tests.llm.conftest import frame, prose


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Share, stop at the cap, share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        t = {s: rest * w[s] / max(sum(w[x] for x in free), 1) for s in free}
        over = {s for s in free if t[s] > cap * sizes[s]}
        if not over:
            return {**t, **{s: cap * sizes[s] for s in capped}}
        capped |= over


def test_targets_and_nearness(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(1, 80)), "en", rng.choice(["a", "a", "a", "b", "c", "Z", "é", None])) for i in range(400)]
    rows += [(1000, prose(rng, 3), "en", "tiny"), (1001, None, "en", "nothing"), (None, prose(rng, 9), "en", "a")]
    docs = frame(spark, rows)
    got = M.mix(docs).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = targets(sizes)
    taken, target = collections.Counter(), {}
    source = {r[0]: r[3] for r in rows}
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        assert r.source_size == sizes[s] and r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 6
    assert sorted(map(str, M.mix(docs).collect())) == sorted(map(str, got))
    copies = collections.Counter(r.doc_id for r in M.apply_mix(docs).collect())
    assert copies == collections.Counter({r.doc_id: r.copies for r in got if r.copies})


def test_ties_empty_and_messy(spark, empty, messy, messy_rows):
    assert M.apply_mix(empty).collect() == []
    mixed = M.apply_mix(messy)
    assert mixed.columns == messy.columns and {r.doc_id for r in mixed.collect()} <= {r[0] for r in messy_rows}
    same = frame(spark, [(7, "a b c", "en", "s")] * 20)  # one hash: taken together
    assert {r.taken for r in M.mix(same).collect()} == {3}
