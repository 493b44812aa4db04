"""Vectorised byte kernels (numpy over Arrow buffers): slices of texts, words, hashes of words and of n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that one vectorised step works on; temporaries are about 60 times as much.
SEGMENT = 1 << 19

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _lut(keep: bytes) -> np.ndarray:
    """Byte to lower-cased byte plus one; 0 where the byte separates words."""
    t = np.zeros(256, np.uint16)
    for b in keep:
        t[b] = (b + 32 if 65 <= b <= 90 else b) + 1
    return t


#: [^\x20\x09-\x0D]+ after A-Z are lower-cased
SPACED = _lut(bytes(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased
ALNUM = _lut(bytes(b for b in range(256) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        n = max(n, SEGMENT + 1024)
        for k, base in (("p", _P), ("i", _P_INV)):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a)
    return _powers["p"], _powers["i"]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets into them; a null text is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offs = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, size: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes in all; a longer document is a range of its own."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


class Words:
    """start, end (bytes), hash of each word, and first: the n + 1 offsets of the documents' words."""

    __slots__ = ("start", "end", "hash", "first")

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lut: np.ndarray):
        starts, ends, hashes = [], [], []
        head = np.zeros(len(buf) + 1, bool)
        head[offs] = True
        a, n = 0, len(buf)
        while a < n:
            b = min(a + SEGMENT, n)
            while b < n and lut[buf[b]] and not head[b]:  # on to the end of the word
                b += 1
            m = lut[buf[a:b]]
            word, h = m > 0, head[a : b + 1]
            prev = np.empty(len(m), bool)
            prev[0], prev[1:] = False, word[:-1]
            s = np.flatnonzero(word & (~prev | h[:-1]))
            nxt = np.empty(len(m), bool)
            nxt[-1], nxt[:-1] = False, word[1:]
            e = np.flatnonzero(word & (~nxt | h[1:])) + 1
            p, inv = _power(len(m) + 1)
            c = np.zeros(len(m) + 1, np.uint64)
            np.cumsum(m.astype(np.uint64) * p[: len(m)], out=c[1:])
            starts.append(s + a)
            ends.append(e + a)
            hashes.append(mix((c[e] - c[s]) * inv[s] + (e - s).astype(np.uint64)))
            a = b
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.start, self.end, self.hash = cat(starts, np.int64), cat(ends, np.int64), cat(hashes, np.uint64)
        self.first = np.searchsorted(self.start, offs)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words, by the first one's place; also those that run over documents' ends."""
    k = len(h) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    g = h[:k].copy()
    for j in range(1, n):
        g = g * _P + h[j : k + j]
    return mix(g)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(at - starts, counts)


def char_offsets(buf: np.ndarray) -> np.ndarray:
    """Code points before each byte, and in all."""
    c = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=c[1:])
    return c
