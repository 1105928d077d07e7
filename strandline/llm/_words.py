"""Words and word shingles as 64-bit hashes, a block of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_P = np.uint64(0x5851F42D4C957F2D)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
#: Characters of text that are worked on at once.
BLOCK = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit of x."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def blocks(texts: list[str | None], size: int = BLOCK) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) of runs of texts with about ``size`` characters; every text is whole."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= size or i + 1 == len(texts):
            yield first, [x or "" for x in texts[first : i + 1]]
            first, held = i + 1, 0


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z as a-z, and for each text the index of its first word (and the end)."""
    raw = [t.encode("utf-8", "replace").translate(_LOWER) for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = _SPACE[buf]
    at = np.flatnonzero(~space)
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    first = np.empty(len(at), bool)
    first[0] = True
    np.greater(at[1:] - at[:-1], 1, out=first[1:])
    head = np.flatnonzero(first)
    size = np.diff(head, append=len(at))
    pos = np.arange(len(at)) - np.repeat(head, size)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(size.max()) - 1, _P)]))
    h = mix(np.add.reduceat(_BYTE[buf[at]] * power[pos], head) ^ size.astype(np.uint64))
    return h, np.concatenate([[0], np.searchsorted(at[head], ends)])


def shingles(texts: list[str], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every run of n words; a text of fewer words has one run of them all, one of none has none."""
    h, start = word_hashes(texts)
    count = np.diff(start)
    runs = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(texts)), runs)
    begin = np.repeat(start[:-1], runs) + np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs)
    size = np.minimum(n, count)[doc]
    out = np.zeros(len(doc), np.uint64)
    for i in range(n):
        more = size > i
        out[more] = mix(out[more] ^ h[begin[more] + i])
    return doc, out
