"""Vectorised word and window hashes over UTF-8 bytes, for Python workers."""

from __future__ import annotations

import re

import numpy as np

U = np.uint64
MASK = (1 << 64) - 1
#: Odd multipliers of the byte and word polynomials, one pair for each hash.
BYTE_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORD_BASE = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
PIECE = 1 << 20
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_space = re.compile(rb"[\x20\x09-\x0D]")
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        n = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(n, b, U)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        got = _powers[base] = tuple(out)
    return got


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def pieces(data: bytes) -> list[bytes]:
    """``data`` cut at separators into pieces of bounded size (a longer word
    stays whole), so that a very long text needs no arrays of its length."""
    out, at = [], 0
    while len(data) - at > PIECE:
        cut = _space.search(data, at + PIECE)
        if cut is None:
            break
        out.append(data[at : cut.start()])
        at = cut.end()
    out.append(data[at:])
    return out


def spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, and where each word starts and ends."""
    a = np.frombuffer(data, np.uint8)
    word = ~SPACES[a]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    return a, edge[::2], edge[1::2]


def word_hashes(data: bytes, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of one piece, and each word's first byte."""
    a, s, e = spans(data)
    if not len(s):
        return np.empty(0, U), s
    p, inv = powers(BYTE_BASE[which], len(a) + 1)
    total = np.zeros(len(a) + 1, U)
    np.cumsum((a.astype(U) + U(1)) * p[: len(a)], out=total[1:])
    h = (total[e] - total[s]) * inv[s]
    return mix(h + (e - s).astype(U) * U(0x632BE59BD9B4E019)), s


def window_hashes(words: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """A hash of each run of ``k`` consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U)
    p, inv = powers(WORD_BASE[which], len(words) + 1)
    total = np.zeros(len(words) + 1, U)
    np.cumsum(words * p[: len(words)], out=total[1:])
    return mix((total[k:] - total[:n]) * inv[:n])


def grouped(texts: list[bytes]) -> list[tuple[list[int], bytes]]:
    """Texts joined by spaces into buffers of bounded size, with their rows; a
    longer text comes alone."""
    out, rows, parts, size = [], [], [], 0
    for i, t in enumerate(texts):
        if rows and size + len(t) > PIECE:
            out.append((rows, parts))
            rows, parts, size = [], [], 0
        rows.append(i)
        parts.append(t)
        size += len(t) + 1
    if rows:
        out.append((rows, parts))
    return out


def hashed_texts(texts: list[bytes], which: int = 0) -> list[np.ndarray]:
    """The word hashes of each text."""
    out: list[np.ndarray] = [np.empty(0, U)] * len(texts)
    for rows, parts in grouped(texts):
        if len(parts) == 1 and len(parts[0]) > PIECE:
            out[rows[0]] = np.concatenate([word_hashes(x, which)[0] for x in pieces(parts[0])])
            continue
        h, s = word_hashes(b" ".join(parts), which)
        ends = np.cumsum([len(p) + 1 for p in parts])
        cut = np.searchsorted(s, ends)
        at = 0
        for r, c in zip(rows, cut, strict=True):
            out[r] = h[at:c]
            at = c
    return out
