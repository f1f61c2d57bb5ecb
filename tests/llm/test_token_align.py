"""Alignment of two tokenizers against a plain set intersection of byte offsets."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from harvestry.llm import token_align as A
from harvestry.llm.tokens import BYTE_LETTERS
from tests.llm.conftest import frame

ODD = ["a▁b", "tab\there\n\nx", "<|endoftext|> </s><s>", "\u0000x", "é \U0001d4b3\U0001f600", "   ", "\n", "x" * 3000, "<0x41>", " lead", "tail "]


@pytest.fixture(scope="module")
def tokenizers():
    t = Tokenizer.from_file(P.path(A.BYTE_BPE))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=P.path(A.PIECE_BPE))


def brute(tokenizers, rows):
    """Rows of the contract, by the reference tokenizer and sets of offsets."""
    t, sp = tokenizers
    letters = {c: b for b, c in BYTE_LETTERS.items()}
    docs = []
    for doc_id, text, *_ in rows:
        a, b, groups = [], [], []
        if text:
            e = t.encode(" " + text, add_special_tokens=False)
            bytes_a = [bytes(letters.get(c, ord(c)) for c in x) for x in e.tokens]
            ids_b = sp.encode(text)
            pieces = [sp.id_to_piece(i) for i in ids_b]
            bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                a, b = e.ids, ids_b
                ends_a, ends_b = (np.cumsum([len(x) for x in y]).tolist() for y in (bytes_a, bytes_b))
                shared, i, j = sorted(set(ends_a) & set(ends_b)), 0, 0
                for end in shared:
                    x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
                    groups.append((a[i:x], b[j:y]))
                    i, j = x, y
        docs.append((doc_id, a, b, groups))
    count = Counter((x[-1], y[-1]) for *_, groups in docs for x, y in groups)
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for doc_id, a, b, groups in docs:
        links = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(count[k] == most[k[1]] for k in links), sum(count[k] for k in links),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_pairs", [1 << 22, 100])
def test_equals_brute_force(spark, tokenizers, messy_rows, block_pairs):
    rows = messy_rows + [(100 + i, x, "en", "a") for i, x in enumerate(ODD)]
    got = A.link_counts(frame(spark, rows).repartition(3), block_pairs=block_pairs).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(tokenizers, rows)


def test_empty_table(spark, empty):
    got = A.link_counts(empty)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and got.count() == 0


def test_runs_are_skipped_right():
    """Every pattern of short irregular groups between runs of every length."""
    rng = random.Random(3)
    for _ in range(400):
        ends = np.cumsum([rng.randrange(1, 4) for _ in range(rng.randrange(0, 80))]).tolist()
        a, b = ([x for x in ends[:-1] if rng.random() < p] + ends[-1:] for p in (rng.random(), rng.random()))
        at_a, at_b = A.common_ends(np.array(a, np.int64), np.array(b, np.int64))
        shared = sorted(set(a) & set(b))
        assert [a[i] for i in at_a] == shared == [b[j] for j in at_b]


def test_alignments_hold_the_groups(spark, tokenizers):
    row = A.alignments(frame(spark, [(1, "naïve tokenizers disagree, often", "en", "a"), (2, None, "en", "a")])).orderBy("doc_id").collect()
    t, sp = tokenizers
    text = "naïve tokenizers disagree, often"
    assert row[0].a_ids == t.encode(" " + text, add_special_tokens=False).ids and row[0].b_ids == sp.encode(text)
    last = row[0].group_ends[-1]
    assert (last.a, last.b) == (len(row[0].a_ids) - 1, len(row[0].b_ids) - 1) and row[1].a_ids == [] == row[1].group_ends


def test_byte_tokens_equal_the_reference_tokenizer(tokenizers):
    pair, rng = A.TokenPair(A.BYTE_BPE, A.PIECE_BPE), random.Random(4)
    for text in [*ODD, *("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), 10, 32])) for _ in range(300)) for _ in range(50))]:
        assert pair.a.encode_ordinary(" " + text) == tokenizers[0].encode(" " + text, add_special_tokens=False).ids
