"""Vectorised word and shingle hashing straight on Arrow string buffers.

Everything here works on the UTF-8 bytes of a whole Arrow batch with NumPy, so
no Python string is made per word.  Hashes are 64 bit: a random value per byte
goes into a polynomial modulo 2**64, and a finaliser mixes the sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_Q = [np.uint64(int(x) | 1) for x in _RNG.integers(0, 2**64, 64, dtype=np.uint64)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


_POW, _IPOW = _powers(_P, SEGMENT + 1), _powers(_P_INV, SEGMENT + 1)


def _table(word_byte, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: whether it belongs to a word, and the value hashed for it."""
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    return np.array([word_byte(int(b)) for b in fold]), _BYTE[fold]


#: Words of bytes that are no ASCII white space; A-Z are lower-cased.
SPACED = _table(lambda b: b != 0x20 and not 9 <= b <= 13, True)
#: Words of digits, letters (A-Z lower-cased) and every non-ASCII character.
ALNUM = _table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128, True)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix, in a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column, most_bytes: int = 1 << 22):
    """(first row, bytes, offsets) of runs of rows of about most_bytes; a longer text is a run of its own."""
    data, offsets = buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word, and for each text the number of its first word (one more entry at the end)."""
    is_word, value = kind
    hashes, firsts, lasts = [], [], []
    a, n = 0, len(data)
    while a < n:
        b = min(a + SEGMENT, n)
        if b < n:
            k = int(offsets[np.searchsorted(offsets, b, "right") - 1])
            if k > a:
                b = k
            else:  # a long text: cut it where no word is
                gap = np.flatnonzero(~is_word[data[a:b]])
                while not len(gap) and b < n and b not in offsets:
                    c = min(b + SEGMENT, int(offsets[np.searchsorted(offsets, b, "right")]))
                    if len(more := np.flatnonzero(~is_word[data[b:c]])):
                        b = b + int(more[0])
                        break
                    b = c
                if len(gap):
                    b = a + int(gap[-1]) + 1
        part = data[a:b]
        inside = is_word[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")] - a] = True
        edge[0] = edge[-1] = True
        edge[1:-1] |= inside[1:] != inside[:-1]
        begins = inside & edge[:-1]
        ends = inside & edge[1:]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        power, inverse = (_POW, _IPOW) if len(part) <= SEGMENT else (_powers(_P, len(part) + 1), _powers(_P_INV, len(part) + 1))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(value[part] * power[: len(part)], out=total[1:])
        h = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)
        hashes.append(mix(h))
        firsts.append(s + a)
        lasts.append(e + a)
        a = b
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    start = np.concatenate(firsts)
    return np.concatenate(hashes), start, np.concatenate(lasts), np.searchsorted(start, offsets)


def runs(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width consecutive words (the first len(h) - width + 1 positions)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _Q[0]
    for k in range(1, width):
        out += h[k : k + n] * _Q[k % len(_Q)]
    return mix(out + np.uint64(width))


def shingles(h: np.ndarray, first: np.ndarray, width: int):
    """For each text the sorted distinct hashes of its runs of width words; of a shorter text, that of all its words."""
    whole = runs(h, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(whole[a : b - width + 1])
        elif b > a:
            yield runs(h[a:b], b - a)
        else:
            yield whole[:0]
