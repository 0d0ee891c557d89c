"""Token ids of whole texts: each different word is encoded once per Python worker and then looked up."""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd

from tidegate.llm.words import BLANKS, BYTES, Words

TABLE_WORDS = 1_500_000
ENDINGS = np.isin(BYTES, list(b".,;:!?%$*#&"))
PROBES = ["a b", " a", "a  b\nc", "\nA.\n b's 12", "é ñ\nß ", "Ab, aB. é! 12; x%%$*** The.it don't, a.'s b#'c"]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Encodes texts with a tokenizer file, without special tokens added.

    A tokenizer that drops white space, ignores the case of A-Z and ends a word before punctuation gives a text's ids
    as those of its words and punctuation in a row. This is probed at the start; then each word is encoded once and
    its ids are kept by the word's 64-bit hash in a table of bounded size. Other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = None
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self._clear()
        pieces = [(p, self._words([p])) for p in PROBES]
        self.by_word = all(
            self._whole([p])[0] == sum(self._whole([w.text(i) for i in range(len(w.starts))]), []) for p, w in pieces)
        if self.by_word:  # for single words of letters in normal form there is nothing to normalise
            plain = Tokenizer.from_file(path)
            plain.normalizer = normalizers.Sequence([])
            letters = ["the", "é", "zzqx", "ñandú", "straße"]
            if [e.ids for e in plain.encode_batch_fast(letters, add_special_tokens=False)] == self._whole(letters):
                self.plain = plain

    @staticmethod
    def _words(texts: list[str]) -> Words:
        return Words(texts, BLANKS, ENDINGS, raw_markup=True)

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, new: list[str]) -> list[list[int]]:
        if not self.plain:
            return self._whole(new)
        simple = [w.isalpha() and w == w.lower() and (w.isascii() or unicodedata.is_normalized("NFC", w)) for w in new]
        out: list[list[int]] = [[]] * len(new)
        for chosen, encode in ((True, self.plain), (False, self.tokenizer)):
            at = [i for i, s in enumerate(simple) if s is chosen]
            for i, e in zip(at, encode.encode_batch_fast([new[i] for i in at], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the offsets of the texts in it (one more than texts)."""
        if not self.by_word:
            return joined(self._whole(texts))
        found = self._words(texts)
        code, keys = pd.factorize(found.hashes)
        if len(self.keys) > TABLE_WORDS:
            self._clear()
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        if not known.all():
            first = np.zeros(len(keys), np.int64)
            first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            self._learn(keys[~known], [found.text(i) for i in first[~known]])
            at = np.searchsorted(self.keys, keys)
        row = at[code]
        ids, ends = gathered(self.ids, self.starts[row], self.lengths[row])
        return ids, np.concatenate([[0], ends]).astype(np.int64)[found.bounds]

    def _learn(self, keys: np.ndarray, new: list[str]) -> None:
        flat, offsets = joined(self._each(new))
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.starts = np.insert(self.starts, at, (offsets[:-1] + len(self.ids))[order])
        self.lengths = np.insert(self.lengths, at, np.diff(offsets)[order])
        self.ids = np.concatenate([self.ids, flat])


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks that a Python worker runs in turn."""
    return Encoder(path)


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of values in a row, and where each ends."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)], ends


def joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    return np.array([i for x in lists for i in x], np.uint32), offsets
