"""The trie against one built turn by turn in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestry.llm import common
from harvestry.llm import prefix_trie as P

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                       T.StructField("text", T.StringType()),
                       *[T.StructField(c, T.StringType()) for c in ("conv", "depth", "x1", "part", "place", "weight", "block", "bytes", "base")]])
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 9) for r in rows], SCHEMA)


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{role}\0{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    kids, out = {}, []
    for key in nodes:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    def below(key):
        found, stack = [], [key]
        while stack:
            k = stack.pop()
            found.append(k)
            stack += kids.get(k, [])
        return found
    for key, members in nodes.items():
        sub = below(key)
        ids = ",".join(str(c) for c in sorted(members) if len(full[c]) == len(key))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(kids.get(key, [])), sum(k not in kids for k in sub),
                    sum((len(nodes[k]) - 1) * len(k[-1][1].encode()) for k in sub if k), hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    nodes, lists = P.prefix_trie(conversations(spark, rows).repartition(3))
    assert sorted((tuple(r) for r in nodes.select(*NAMES).collect()), key=str) == brute(rows)
    return lists


def made(seed, n, words):
    """Conversations that share beginnings, copies of whole ones, ties, nulls and repeated rows."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(10 * n), n):
        for t in range(rng.choice([1, 2, 3, 7, 12])):
            rows.append((c, t, rng.choice(["user", "user", None]), rng.choice(words)))
    return rows + rng.sample(rows, n // 4) + [(c, None, "s", "first") for c in range(0, n, 7)] + [(None, 1, "user", "lost")] * 3


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    check(spark, made(seed, 120, ["a", "é", "", None, "longer text"]))


def test_long_conversations_cross_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 4)
    monkeypatch.setattr(P, "LIST_IDS", 2)
    rows = made(3, 60, ["a", "b"]) + [(c, t, "user", f"turn {t}") for c in (5, 6, 7, 1000) for t in range(60)]
    lists = check(spark, rows)
    assert lists.agg(F.max("nth")).first()[0] > 0


def test_hot_nodes(spark, monkeypatch):
    """Many equal conversations, and one node with many children."""
    monkeypatch.setattr(common, "HOT_GROUPS", 3)
    rows = [(c, t, "user", "same") for c in range(300) for t in range(3)] + [(c, t, "user", "same" if t < 9 else f"{c}") for c in range(1000, 1100) for t in range(11)]
    check(spark, rows)


def test_all_empty_and_missing_bases(spark):
    check(spark, [(7, 0, None, None), (8, None, "", ""), (9, 3, "u", "x"), (1, 0, "u", "x")])


def test_turnless_only(spark):
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    rows = [(c, 0, "u", "x")]  # its base is absent and its one turn is left out
    check(spark, rows)


def test_long_text_and_empty_table(spark):
    check(spark, [(10, 0, "user", "x" * 2_000_000), (10, 1, "user", "y"), (15, 0, "user", "x" * 2_000_000)])
    nodes, lists = P.prefix_trie(conversations(spark, []))
    assert nodes.count() == 0 == lists.count() and set(NAMES) <= set(nodes.columns)
