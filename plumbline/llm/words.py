"""Words and word-window hashes of a text, for code inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words of which a worker remembers the hash; beyond it, hashes are computed anew.
REMEMBERED = 400_000

_K = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """64-bit hash of each word (bytes)."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split(text: str | None, *, lower: bool = False) -> list[bytes]:
    """Maximal runs of code points outside 0x20 and 0x09-0x0D; ``lower`` maps A-Z only."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def split_column(texts: pa.Array, *, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The words, as ``split`` has them, of all texts of a column of strings, one text after the other, and how many each text has."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    ends, words = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
    full = pc.binary_length(words).to_numpy() > 0  # a blank at either end leaves an empty word
    counts = np.diff(np.concatenate([[0], np.cumsum(full)])[ends - ends[0]])
    return (words if full.all() else words.filter(pa.array(full))).cast(pa.binary()), counts


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each ``size`` consecutive words; for a shorter text, one for the whole (none without words)."""
    n = len(hashes)
    size_here = min(size, n)
    if not n:
        return hashes
    out = mix(hashes[: n - size_here + 1] + np.uint64(size_here))
    for k in range(1, size_here):
        out = mix(out * _K + hashes[k : n - size_here + 1 + k])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


class Rolling:
    """Hashes of any span of a word sequence, and of the sequence with one word left out."""

    base = np.uint64(0x5851F42D4C957F2D)
    inverse = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))

    def __init__(self):
        self._up, self._down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            self._up, self._down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, b)]), dtype=np.uint64) for b in (self.base, self.inverse))

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        self._powers(len(hashes) + 1)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self._up[: len(hashes)], dtype=np.uint64)])

    def spans(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray, tag: int = 0) -> np.ndarray:
        """A hash of each [begin, end): of its words, its length and ``tag``."""
        raw = (sums[end] - sums[begin]) * self._down[begin]
        return mix(mix(raw + (end - begin).astype(np.uint64)) + np.uint64(tag))

    def without_one(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For word i of the sequence, in [begin, end): a hash of that span without the word; equal to ``spans`` of the shorter span."""
        raw = ((sums[:-1] - sums[begin]) + (sums[end] - sums[1:]) * self.inverse) * self._down[begin]
        return mix(mix(raw + (end - begin - 1).astype(np.uint64)))


def sketch_bits(df, column: str, bits: int) -> np.ndarray:
    """A bitmap of 2**bits positions with those of ``column``'s values (long) set.

    Its size is fixed by ``bits`` whatever the number of rows; a value that was not there
    may look as if it was, never the other way round.
    """
    from pyspark.sql import functions as F

    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = df.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    out = np.zeros(1 << (bits - 6), np.int64)
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint64)


def in_sketch(sketch: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the (unsigned) values may be in the sketch."""
    at = values & np.uint64(len(sketch) * 64 - 1)
    return (sketch[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
