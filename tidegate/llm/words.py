"""Words of many texts at once, as stretches of one byte array with 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE_CHARS = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)

BYTES = np.arange(256)
#: Separators of words: a blank or a line end; white space; all ASCII but digits and letters.
BLANKS = np.isin(BYTES, [10, 32])
WHITE = np.isin(BYTES, [9, 10, 11, 12, 13, 32])
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
ASCII_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])


def slices(texts: list[str], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about so many characters; one longer text is a range of its own."""
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > chars:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of some texts, A-Z in lower case: starts, ends and hashes of words; bounds of texts in them.

    `separators` says by byte what stands between words (line ends must). With `endings`, a word also ends where one
    of these bytes follows an ASCII letter or digit. With `raw_markup`, texts keep their case if one has "<|".
    """

    _powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __init__(self, texts: list[str], separators: np.ndarray, endings: np.ndarray | None = None,
                 raw_markup: bool = False):
        encoded = [t.encode("utf-8", "replace") for t in texts]
        self.raw = b"\n".join(encoded) + b"\n"
        if not raw_markup or b"<|" not in self.raw:
            self.raw = self.raw.lower()
        a = np.frombuffer(self.raw, np.uint8)
        inside = ~separators[a]
        before = np.concatenate([[False], inside[:-1]])
        starts, ends = inside & ~before, ~inside & before
        if endings is not None:
            cut = endings[a[1:]] & ASCII_ALNUM[a[:-1]]
            starts[1:] |= cut
            ends[1:] |= cut
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends)
        self.text_starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in encoded])]).astype(np.int64)
        self.bounds = np.searchsorted(self.starts, self.text_starts)
        power, self._inverse = self._power(len(a) + 1)
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((a + np.uint64(1)) * power[: len(a)])])
        self.hashes = self.hashed(self.starts, self.ends)

    def hashed(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of stretches of bytes: a polynomial of the bytes, mixed with the length."""
        h = (self._sums[ends] - self._sums[starts]) * self._inverse[starts]
        return mixed(h ^ ((ends - starts).astype(np.uint64) << np.uint64(56)))

    @classmethod
    def _power(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._powers[0]) < n:
            cls._powers = (powers(BASE, n), powers(np.uint64(pow(int(BASE), -1, 1 << 64)), n))
        return cls._powers

    def owner(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def text(self, i: int) -> str:
        return self.raw[self.starts[i]: self.ends[i]].decode()


