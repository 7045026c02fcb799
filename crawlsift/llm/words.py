"""Words of many texts as 64-bit hashes, with numpy over the bytes: no Python object per word."""

from __future__ import annotations

import functools

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATION = SPACE.copy()
PUNCTUATION[[x for x in range(128) if not chr(x).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
BASE = 0x9E3779B97F4A7C15
SEGMENT = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return _make_powers(SEGMENT * 2)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """As many powers of the base and of its inverse modulo 2^64; kept only at the usual length."""
    return _usual_powers() if n <= SEGMENT * 2 else _make_powers(n)


def _make_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _segment(data: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in one run of bytes: differences of a running polynomial sum."""
    space = gap[data]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    return start, end, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def located(docs: list[bytes], gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, each closed by a newline; starts, ends and hashes (A-Z lower-cased) of their words, the runs without a
    byte of `gap`; and per document the offset of its first word (one more at the end)."""
    return located_in(*joined(docs), gap)


def joined(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each closed by a newline, and where each begins (one more at the end)."""
    return np.frombuffer(b"\n".join(docs) + b"\n", np.uint8), np.cumsum([0, *(len(x) + 1 for x in docs)])


def located_in(data: np.ndarray, begin: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for texts that are joined already."""
    starts, ends, hashes, at = [], [], [], 0
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        while end < len(data) and not gap[data[end - 1]]:  # a segment ends behind a gap, however long a word is
            found = np.flatnonzero(gap[data[end:end + SEGMENT]])
            end = end + int(found[0]) + 1 if len(found) else min(end + SEGMENT, len(data))
        start, stop, value = _segment(data[at:end], gap)
        starts.append(start + at)
        ends.append(stop + at)
        hashes.append(value)
        at = end
    start = np.concatenate(starts)
    return data, start, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(start, begin)


def hashed(docs: list[bytes], gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the offsets of the documents' first words."""
    return located(docs, gap)[3:]


def shingles(words: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and their document; fewer words make one shingle, no words none."""
    counts = np.diff(offsets)
    weights = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
    long = np.flatnonzero(counts >= k)
    if len(words) >= k and len(long):
        n = len(words) - k + 1
        value = words[:n] * weights[0]
        for i in range(1, k):
            value += words[i:n + i] * weights[i]
        runs = counts[long] - k + 1
        doc = np.repeat(long, runs)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs) + offsets[doc]
        value = mix(value[place])
    else:
        doc, value = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        total = counts[short].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for i in range(k - 1):
            has = counts[short] > i
            total[has] += words[offsets[short[has]] + i] * weights[i]
        doc, value = np.concatenate([doc, short]), np.concatenate([value, mix(total)])
    return value, doc


def sets(docs: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct shingles of all texts, one after the other; per text the place of its first one and their number."""
    value, offsets = hashed(docs)
    gram, doc = shingles(value, offsets, k)
    order = np.lexsort((gram, doc))
    gram, doc = gram[order], doc[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    gram, sizes = gram[new], np.bincount(doc[new], minlength=len(docs))
    return gram, np.cumsum(sizes) - sizes, sizes


def identities(gram: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit identities of sets, equal for equal ones."""
    total = np.add.reduceat(mix(gram + np.uint64(BASE)), starts) + sizes.astype(np.uint64)
    return mix(total).view(np.int64)
