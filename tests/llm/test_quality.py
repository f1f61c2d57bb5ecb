import collections
import random
import re

from pyspark.sql import functions as F

from harvestry.llm import quality as Q
from tests.llm.conftest import frame, prose

W = re.compile(r"[^\x20\x09-\x0D]+")


def stats(text):
    text = text or ""
    w = W.findall(text)
    c = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    cover = set()
    for i in range(len(w) - 4):
        if c[tuple(w[i:i + 5])] > 1:
            cover |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if W.search(x)]
    return (len(w), sum(map(len, w)), sum(text.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover), len(lines))


def test_stats(spark, messy_rows):
    rng = random.Random(1)
    rows = messy_rows + [(100 + i, prose(rng, 40, 3), "en", "a") for i in range(30)] + [(200, "a b c d e " * 9, "x", "y"), (201, "a a a a a a", "x", "y")]
    got = Q.with_stats(frame(spark, rows)).select("doc_id", *Q.STATS).collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted([(r[0], *stats(r[1])) for r in rows], key=str)


def test_sketch_merges_and_bounds_error(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(10, 60)) + " " + "$" * rng.randrange(400), rng.choice("ab"), rng.choice("xy")) for i in range(400)]
    s = Q.with_stats(frame(spark, rows))
    parts = Q.sketch(s.filter("doc_id < 150"), ["lang"]).unionByName(Q.sketch(s.filter("doc_id >= 150"), ["lang"]))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(Q.merge(parts, ["lang"])) == key(Q.sketch(s, ["lang"]))
    worst = s.select(Q.measures()["symbols"].alias("v")).withColumn("bits", F.greatest(F.length(F.bin("v")) - Q.KEPT_BITS, F.lit(0)))
    assert all(r.v - (r.v >> r.bits << r.bits) <= r.v / 2 ** (Q.KEPT_BITS - 1) for r in worst.collect())


def test_junk_goes_and_clean_stays(spark):
    rng = random.Random(3)
    clean = [(i, prose(rng, rng.randrange(30, 300)), rng.choice(["en", "de"]), rng.choice(["a", "b", None])) for i in range(300)]
    junk = [(1000 + i, " ".join(x + "&&&" for x in prose(rng, 50).split()), "en", "a") for i in range(20)]
    rare = [(2000, prose(rng, 80), "zz", "only"), (2001, prose(rng, 5), "en", "a"), (2002, "a b c d e f " * 20, "en", "a"), (2003, None, None, "a")]
    docs = frame(spark, clean + junk + rare)
    kept = {r.doc_id for r in Q.quality_verdicts(docs).filter("kept").collect()}
    assert kept == {r[0] for r in clean} | {2000}
    good = Q.keep_good(docs)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == kept


def test_empty_and_messy(empty, messy, messy_rows):
    assert Q.quality_verdicts(empty).collect() == [] and Q.keep_good(empty).collect() == []
    got = Q.quality_verdicts(messy).collect()
    assert len(got) == len(messy_rows) and all(r.base_failed for r in got if r.doc_id in (3, 4, 5, 11))


def plain_verdicts(rows):
    """The rules once more in plain Python: {id: kept}."""
    facts = []
    for doc_id, text, lang, source in rows:
        n, chars, symbols, dups, repeats, lines = stats(text)
        m = {"symbols": symbols * 1000 // n, "word_length": chars * 100 // n, "repeats": repeats * 1000 // n} if n else {}
        if lines:
            m["dup_lines"] = dups * 1000 // lines
        facts.append((doc_id, lang, source, n < 10 or 100 * repeats > 20 * n, m))

    def rough(v):
        low = max(v.bit_length() - 7, 0)
        return v >> low << low

    def limit_of(group, k):
        values = sorted(rough(m[k]) for _, _, _, _, m in group if k in m)
        if not values:
            return None, None, 0
        q = lambda p: next(v for i, v in enumerate(values, 1) if i * 100 >= len(values) * p)
        if k == "word_length":
            return q(50) - 100 - 4 * (q(90) - q(50)), q(50) + 100 + 4 * (q(50) - q(10)), len(values)
        base, p = {"symbols": (150, 75), "dup_lines": (100, 98), "repeats": (100, 95)}[k]
        return None, base + 4 * q(p), len(values)

    def shrink(own, docs, wider):
        return wider if own is None else (own * docs + wider * 200) // (docs + 200)

    out = {}
    for doc_id, lang, source, failed, m in facts:
        kept = not failed
        for k, v in m.items():
            size = lambda g: max(limit_of(g, x)[2] for x in ("symbols", "word_length", "dup_lines", "repeats"))
            own, tongue = [f for f in facts if f[1:3] == (lang, source)], [f for f in facts if f[1] == lang]
            for side, worse in ((0, v.__lt__), (1, v.__gt__)):
                over = limit_of(facts, k)[side]
                if over is not None:
                    limit = shrink(limit_of(own, k)[side], size(own), shrink(limit_of(tongue, k)[side], size(tongue), over))
                    kept &= not worse(limit)
        out[doc_id] = kept
    return out


def mixed_sources():
    """Prose without symbols in one source; code, with symbols and repeated lines throughout, in another; junk in both."""
    rng = random.Random(6)
    code = lambda: "\n".join(rng.choice(["x = a & b | c", "if a < b: y", f"call {rng.randrange(999)} z", "return %"]) for _ in range(60))
    rows = [(i, prose(rng, rng.randrange(30, 120)), "en", "web") for i in range(260)]
    rows += [(1000 + i, code(), "en", "git") for i in range(260)]
    rows += [(2000 + i, " ".join(w + "&&" for w in prose(rng, 60).split()), "en", rng.choice(["web", "git"])) for i in range(12)]
    rows += [(3000 + i, prose(rng, 50), rng.choice(["de", None]), rng.choice(["web", None])) for i in range(40)]
    same = " ".join(f"{w} &" if i % 3 else w for i, w in enumerate(prose(rng, 60).split()))
    return rows + [(9001, same, "en", "web"), (9002, same, "en", "git")]


def test_one_text_gets_the_verdict_of_its_source(spark):
    rows = mixed_sources()
    kept = {r.doc_id: r.kept for r in Q.quality_verdicts(frame(spark, rows)).collect()}
    assert kept == plain_verdicts(rows)
    assert kept[9002] and not kept[9001]
    assert not any(kept[2000 + i] for i in range(12) if rows[520 + i][3] == "web") and sum(kept[i] for i in range(260)) == 260


def test_each_measure_can_reject_and_limits_follow_the_sketch(spark):
    rows = mixed_sources()
    lim = {(r._lang, r._source): r for r in Q.adaptive_limits(Q.with_stats(frame(spark, rows)).select("lang", "source", *Q.STATS)).collect()}
    web, git = lim["en", "web"], lim["en", "git"]
    assert web._limit_high_symbols < git._limit_high_symbols and web._limit_high_dup_lines < git._limit_high_dup_lines
    assert web._limit_high_repeats != git._limit_high_repeats and web._limit_high_word_length != git._limit_high_word_length
    rng = random.Random(8)
    odd = [(1, "\n".join(["one two three four five six " + str(i // 3) for i in range(60)]), "en", "web"),  # repeated lines
           (2, " ".join("x" * 30 for _ in range(5)) + " " + " ".join(w * 4 for w in prose(rng, 40).split()), "en", "web"),  # long words
           (3, prose(rng, 70) + " " + " ".join(["a b c d e"] * 3), "en", "web")]  # repeated words, under the base rule's share
    got = {r.doc_id: r for r in Q.quality_verdicts(frame(spark, rows + odd)).collect()}
    want = plain_verdicts(rows + odd)
    assert {k: got[k].kept for k in (1, 2, 3)} == {k: want[k] for k in (1, 2, 3)} and not got[2].kept
