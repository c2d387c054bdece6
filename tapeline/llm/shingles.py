"""Words and word shingles of whole texts as 64-bit hashes, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed together up to this many bytes; a longer text is hashed alone, whole.
TOGETHER = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = [U(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, ``n`` at least."""
    if len(_powers[0]) < n:
        size = max(n, TOGETHER + 1)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, U(base))
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x = x * U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def substring_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], by sums of byte times base^place."""
    up, down = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0x9FB21C651E98DF25))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts in a row (A-Z lower-cased, split at ASCII white space), and the words of each text."""
    plain = [b" ".join(t.lower().split()) for t in texts]
    counts = np.array([p.count(b" ") + 1 if p else 0 for p in plain], dtype=np.int64)
    data = np.frombuffer(b" ".join(p for p in plain if p), np.uint8)
    if not len(data):
        return np.zeros(0, U), counts
    gaps = np.flatnonzero(data == 32)
    return substring_hashes(data, np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k-word shingle of all texts in a row, and the number of shingles of each text.

    A text of fewer words has its whole sequence as its one shingle; a text without words has none.
    """
    starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    numbers = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(numbers)])[:-1], numbers) + np.arange(numbers.sum())
    length = np.repeat(np.minimum(counts, k), numbers)
    padded = np.concatenate([words, np.zeros(k, U)])
    out = length.astype(U)
    for i in range(k):
        out = out + np.where(i < length, padded[first + i], U(0)) * _PLACES[i % 5] * U(2 * (i // 5) + 1)
    return mixed(out), numbers


def sets_of(texts: list[bytes], k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    values, numbers = shingle_hashes(*word_hashes(texts), k)
    at = 0
    for n in numbers:
        part = np.sort(values[at : at + n])
        at += n
        yield part[np.concatenate([[True], part[1:] != part[:-1]])] if n > 1 else part


def set_key(values: np.ndarray) -> int:
    """Signed 64-bit fingerprint of a set; 0 for the empty one."""
    if not len(values):
        return 0
    total = mixed(np.bitwise_xor.reduce(mixed(values + U(0x632BE59BD9B4E019)), keepdims=True) + np.array([len(values)], U) * U(_BASE))
    return int(total.view(np.int64)[0]) or 1


def chunks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts) for runs of texts of a column; null texts are empty."""
    start, size, run = 0, 0, []
    for i, t in enumerate(column.cast(pa.binary())):
        t = t.as_py() or b""
        if run and size + len(t) > TOGETHER:
            yield start, run
            start, size, run = i, 0, []
        run.append(t)
        size += len(t)
    if run:
        yield start, run
