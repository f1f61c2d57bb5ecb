"""Token ids of whole texts in Python workers.

The tokenizer drops white space between words, so a text's ids are the ids of
its ASCII-blank separated pieces one after another. Pieces repeat a lot: each
worker process remembers the ids of those it has seen, up to a bound and across
its tasks, which gives the same ids as encoding the text at once and takes a
fraction of the time.
"""

from __future__ import annotations

import re
import sys
import types
from itertools import chain

import numpy as np

WORD_BPE = "word_bpe_49k.json"
#: Letters of ASCII and Latin-1 (each composed, with a lower case of its own), then ASCII signs but ' and <: to this
#: tokenizer's pattern one word and one run of signs.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=>?@\\[-`{-~]*)")
#: Pieces remembered (about 200 bytes each). When the store is full and more than one lookup in five misses, it starts anew.
KNOWN = 1_000_000


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_LETTERS = byte_letters()


def worker_encoder(tokenizer: str, specials_as_text: bool = False) -> TextEncoder:
    """The encoder of this Python worker process, made by its first task."""
    kept = sys.modules.setdefault("_text_encoders", types.ModuleType("_text_encoders")).__dict__
    key = (tokenizer, specials_as_text)
    if key not in kept:
        kept[key] = TextEncoder(tokenizer, specials_as_text)
    return kept[key]


class TextEncoder:
    """``specials_as_text``: the tokenizer's special strings inside a text are ordinary text."""

    def __init__(self, tokenizer: str, specials_as_text: bool = False):
        import os

        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer))
        self.tokenizer.encode_special_tokens = specials_as_text
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.signs: dict[str, list[int]] = {}
        self.plain = tokenizer.endswith(WORD_BPE)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 12, np.int64)
        self.used = self.looked = self.missed = 0

    def _direct(self, pieces: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of the pieces, and of the lower-case words inside them."""
        out, rest, known = {}, [], self.known
        tokenize = self.tokenizer.model.tokenize
        for p in pieces:
            m = PLAIN.fullmatch(p.decode()) if self.plain else None
            if m is None:
                rest.append(p)
                continue
            word = m[1].lower().encode()
            ids = out.get(word)
            if ids is None:
                k = known.get(word)
                if k is None:
                    letters = m[1].lower() if word.isascii() else word.decode("latin-1").translate(BYTE_LETTERS)
                    ids = out[word] = [t.id for t in tokenize(letters)]
                else:
                    ids = self.ids[self.starts[k]:self.starts[k + 1]].tolist()
            if p != word:
                out[p] = ids + self._signs(m[2]) if m[2] else ids
        out.update(zip(rest, (e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in rest], add_special_tokens=False))))
        return out

    def _signs(self, signs: str) -> list[int]:
        if signs not in self.signs:
            if len(self.signs) > 10_000:
                self.signs.clear()
            self.signs[signs] = self.tokenizer.encode(signs, add_special_tokens=False).ids
        return self.signs[signs]

    def _learn(self, found: dict[bytes, list[int]]) -> None:
        flat = np.fromiter(chain.from_iterable(found.values()), np.uint32)
        k, end = len(self.known), self.used + len(flat)
        while end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while k + len(found) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.used:end] = flat
        self.starts[k + 1:k + 1 + len(found)] = self.used + np.cumsum(list(map(len, found.values())))
        self.known.update(zip(found, range(k, k + len(found))))
        self.used = end

    def encode(self, text: str | None) -> np.ndarray:
        pieces = (text or "").encode().split()  # bytes: ASCII blanks only
        at = list(map(self.known.get, pieces))
        if None not in at:
            self.looked += len(at)
            return self._gather(at)
        new = list(dict.fromkeys(p for p, k in zip(pieces, at) if k is None))
        found = self._direct(new)
        self.looked, self.missed = self.looked + len(at), self.missed + len(new)
        if len(self.known) + len(found) <= KNOWN:
            self._learn(found)
            return self._gather(list(map(self.known.get, pieces)))
        out = [found[p] if k is None else self.ids[self.starts[k]:self.starts[k + 1]] for p, k in zip(pieces, at)]
        if self.looked > KNOWN:
            if 5 * self.missed > self.looked:
                self._clear()
            self.looked = self.missed = 0
        return np.concatenate([np.asarray(x, np.uint32) for x in out])

    def _gather(self, at: list[int]) -> np.ndarray:
        k = np.array(at, np.int64)
        first = self.starts[k]
        n = self.starts[k + 1] - first
        ends = np.cumsum(n)
        return self.ids[np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]

    def dtype(self) -> str:
        return "<u2" if self.vocabulary <= 1 << 16 else "<u4"
