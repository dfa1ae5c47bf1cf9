"""Vectorised word and shingle hashing over Arrow text columns (numpy only, used inside Spark tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACES = (9, 10, 11, 12, 13, 32)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(_SPACES)] = True
#: For texts compared without punctuation: all ASCII but letters and digits separates words.
IS_PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on each element."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x2545F4914F6CDD1D)) | U64(1)
_powers = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.full(n + 1, b, dtype=U64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


class Words:
    """The words of a slice of texts: ``hashes`` and byte ranges, and for text ``i`` words ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = IS_SPACE):
        n = len(data)
        self.first = np.zeros(len(offsets), dtype=np.int64)
        self.hashes = np.zeros(0, dtype=U64)
        self.starts = self.ends = np.zeros(0, dtype=np.int64)
        if not n:
            return
        low = LOWER[data]
        inside = ~separators[data]
        before = np.empty(n, dtype=bool)
        before[0], before[1:] = False, inside[:-1]
        after = np.empty(n, dtype=bool)
        after[-1], after[:-1] = False, inside[1:]
        at = offsets[(offsets > 0) & (offsets < n)]
        before[at] = False
        after[at - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        power, inverse = _power(n)
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(_BYTE[low] * power[:n], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts])
        self.first = np.searchsorted(self.starts, offsets)


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) for runs of rows of about SLICE_BYTES; a long text stands alone, whole.

    No copy is made of the column: bytes and offsets are views, unless it has nulls.
    """
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.fill_null("") if texts.null_count else texts
    n = len(texts)
    if not n:
        return
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=width)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, int(offsets[i]) + SLICE_BYTES, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], (offsets[i : j + 1] - offsets[i]).astype(np.int64)
        i = j


def pieces(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in runs of few rows, so that what a task makes of it at once stays small."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
    pa.default_memory_pool().release_unused()


def fold(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash for each sequence of words; ``hashes[i]`` has the i-th word of all of them."""
    out = mix(hashes[0])
    for h in hashes[1:]:
        out = mix(out * U64(0xD6E8FEB86659FD93) + h)
    return out


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, in order; of the whole sequence if it has fewer; none of an empty one."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    return fold([words[i : n - k + 1 + i] for i in range(k)])


def sets_of(w: Words, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a slice; empty for a text without words."""
    n = len(w.hashes)
    runs = fold([w.hashes[x : n - k + 1 + x] for x in range(k)]) if n >= k else w.hashes[:0]
    for t in range(len(w.first) - 1):
        a, b = w.first[t], w.first[t + 1]
        yield np.unique(runs[a : b - k + 1]) if b - a >= k else shingle_hashes(w.hashes[a:b], k)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text, as an array for each; empty for a text without words or a null."""
    for _, _, data, offsets in slices(texts):
        yield from sets_of(Words(data, offsets), k)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set, as two signed longs; (0, 0) for the empty set."""
    if not len(s):
        return 0, 0
    a = mix(np.add.reduce(mix(s))[None] + U64(len(s))).view(np.int64)
    b = mix(np.add.reduce(mix(s ^ U64(0x5851F42D4C957F2D)))[None]).view(np.int64)
    return int(a[0]), int(b[0])
