"""Words of a column of texts as numpy arrays: positions and 64-bit hashes, no loop over words.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Its hash is a polynomial
over its bytes modulo 2**64, read off prefix sums and then mixed; runs of words
are hashed the same way over the hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection of 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.ones(size, U)
        have[1:] = U(base)
        have = np.multiply.accumulate(have)
        if size <= 2 * CHUNK_BYTES:
            _powers[key] = have
    return have[:n]


class Words:
    """Words of some documents.

    starts, ends: byte positions in data; ptr[i]:ptr[i + 1] are document i's words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.data = _LOWER[data] if lower else data
        n = len(data)
        word = np.zeros(n + 2, bool)
        word[1:-1] = ~_WHITE[data]
        cut = np.zeros(n + 2, bool)
        cut[self.offsets + 1] = True
        begins = word[1:] & (~word[:-1] | cut[1:])
        ends = word[:-1] & (~word[1:] | cut[1:])
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends)
        self.ptr = np.searchsorted(self.starts, self.offsets)
        self.n_words = np.diff(self.ptr)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_words)), self.n_words)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        sums = np.zeros(n + 1, U)
        np.cumsum(_BYTES[self.data] * _power(BASE, n), out=sums[1:])
        spans = (sums[self.ends] - sums[self.starts]) * _power(BASE_INVERSE, n)[self.starts] if n else np.zeros(0, U)
        return mix(spans + (self.ends - self.starts).astype(U) * U(0xA0761D6478BD642F))

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def runs(hashes: np.ndarray, docs: np.ndarray, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one document, and the index of the word each starts at."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    out = np.zeros(n, U)
    for j in range(k):
        out += hashes[j : j + n] * U(pow(BASE, j + seed, 1 << 64))
    at = np.flatnonzero(docs[:n] == docs[k - 1 :])
    return mix(out[at] + U(k * 0x632BE59BD9B4E019 % (1 << 64))), at


def chunks(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole documents of about `most` bytes of text; a longer document stands alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    begin = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield batch.slice(begin)
