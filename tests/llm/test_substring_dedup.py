import collections
import random

import pytest

from harvestry.llm import substring_dedup as D
from tests.llm.conftest import frame, prose


def brute(rows, window):
    words = [(r[1] or "").encode().split() for r in rows]
    count = collections.Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((r[0], len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def result(docs, window):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in D.remove_duplicates(docs, window=window).collect()], key=str)


@pytest.mark.parametrize("window,vocabulary", [(35, 4000), (10, 2), (9, 6), (12, 1)])
def test_equals_brute_force(spark, messy_rows, window, vocabulary):
    """Small vocabularies make anchors repeat by chance and matches stop inside blocks."""
    rng = random.Random(window)
    passages = [prose(rng, rng.randrange(window - 1, 4 * window), vocabulary) for _ in range(4)]
    rows = [(100 + i, " ".join([prose(rng, rng.randrange(0, 30), vocabulary), rng.choice(passages), prose(rng, rng.randrange(0, 9), vocabulary),
                                rng.choice(passages)[rng.randrange(9):]]), "en", "a") for i in range(25)] + messy_rows
    assert result(frame(spark, rows), window) == brute(rows, window)


def test_spans_name_the_removed_words(spark, empty):
    rng = random.Random(8)
    passage = prose(rng, 50)
    docs = frame(spark, [(1, "p q " + passage, "en", "a"), (2, passage + " r s", "en", "a")])
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in D.remove_duplicates(docs).collect()}
    assert got == {1: [(2, 52)], 2: [(0, 50)]}
    assert D.remove_duplicates(empty).collect() == []
