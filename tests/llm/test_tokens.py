import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from harvestry.llm import token_count as C
from harvestry.llm.queries import END_OF_DOCUMENT
from harvestry.llm.tokens import WORD_BPE, TextEncoder
from harvestry.session import shared_path

TRICKY = ["It's 12 o'clock, they'LL go…", "<|endoftext|> x<|startoftext|>y", "É e\u0301 \u212b ﬁ ΣΑΣ", "a\u00a0b\x85c\u2003d\x1ce", "日本語 text, мир!!", "\t\n", "", None,
          "Heed heed, HEED. heed.,;:!? heed'S don't. don'T I'm, \u212aelvin İstanbul ſ ABC123 12,3 a.b x_y, .,. thereby!!! thereby",
          "École école ÉCOLE, ñandú*** Größe größe GRÖSSE ÿ Ÿ Þorn aª 2º µm ×÷ naïve&&& à la À### çà$$$ a<b a<|endoftext|> x' x'' É́ ët"]


def direct(text, specials_as_text=False):
    t = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    t.encode_special_tokens = specials_as_text
    return t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_whole_text():
    for flag in (False, True):
        encoder = TextEncoder(WORD_BPE, flag)
        for text in TRICKY * 2:
            assert encoder.encode(text).tolist() == direct(text, flag)


def test_encoder_with_a_tiny_store(monkeypatch):
    from harvestry.llm import tokens
    monkeypatch.setattr(tokens, "KNOWN", 20)
    encoder, rng = TextEncoder(WORD_BPE), random.Random(1)
    for _ in range(30):
        text = " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(80)))
        assert encoder.encode(text).tolist() == direct(text)


def test_counts_equal_encoding(spark, messy, messy_rows, empty):
    """Blocks of seven tokens cut nearly every document; two scan levels of three blocks stitch them."""
    flat = C.write_flat(messy, END_OF_DOCUMENT, block_tokens=7)
    counts = C.count_tokens(flat.filter("block is not null"), END_OF_DOCUMENT, run=3)
    names = flat.filter("nth is not null").select("file", "nth", "id")
    got = names.join(counts, ["file", "nth"]).collect()
    assert counts.count() == len(got) == len(messy_rows) and all(r.closed for r in got)
    assert sorted([(r.id, r.n_tokens) for r in got], key=str) == sorted([(r[0], len(direct(r[1], True))) for r in messy_rows], key=str)
    none = C.write_flat(empty, END_OF_DOCUMENT)
    assert C.count_tokens(none.filter("block is not null"), END_OF_DOCUMENT).collect() == []


def test_raw_files(spark):
    folder = shared_path(spark, "raw").removeprefix("file://")
    import os
    os.makedirs(folder)
    rng, want = np.random.default_rng(0), {}
    for name in ("a.bin", "b.bin", "c.bin"):
        ids = rng.integers(0, 6, 500).astype("<u2") if name != "c.bin" else np.zeros(0, "<u2")
        ids.tofile(f"{folder}/{name}")
        at = np.flatnonzero(ids == 5)
        want[name] = np.diff(np.concatenate([[-1], at])) - 1, len(ids) - (at[-1] + 1 if len(at) else 0)
    blocks = C.blocks_from_files(spark, folder, 2, 16, split_blocks=3)
    assert blocks.rdd.getNumPartitions() == 22  # 32 blocks a file in 11 splits
    got = C.count_tokens(blocks, 5, run=4).collect()
    for name, (lengths, rest) in want.items():
        own = sorted((r.nth, r.n_tokens, r.closed) for r in got if r.file.endswith(name))
        assert own == [(i, n, True) for i, n in enumerate(lengths)] + ([(len(lengths), rest, False)] if rest else [])


def test_a_torn_raw_file_is_an_error(spark):
    import os

    import pytest
    folder = shared_path(spark, "torn").removeprefix("file://")
    os.makedirs(folder)
    with open(f"{folder}/a.bin", "wb") as f:
        f.write(b"12345")
    with pytest.raises(Exception, match="whole number of tokens"):
        C.blocks_from_files(spark, folder, 2, 16).collect()
