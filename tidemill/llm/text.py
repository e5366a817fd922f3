"""Words, word hashes and shingle sets of many texts at once, on their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

U = np.uint64
GOLD, MIX1, MIX2, BASE = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= MIX1
    x ^= x >> U(27)
    x *= MIX2
    x ^= x >> U(31)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of words: white space of one byte, or all ASCII but digits and letters.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: Keeps the first n bytes of a little-endian 8-byte chunk.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
BLOCK = 1 << 19  # words hashed at once: what a very long text needs beyond its own bytes stays bounded


def spans(data: np.ndarray, at: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (one entry more than texts)."""
    solid = ~separators[data]
    first, last = solid.copy(), solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        full = at[1:] > at[:-1]
        head, tail = at[:-1][full], at[1:][full] - 1
        first[head], last[tail] = solid[head], solid[tail]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans: each 8-byte chunk is mixed with its place, the sum with the length."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 8)
    salt, out = U(mix(np.array([seed], U))[0]), np.empty(len(starts), U)
    for lo in range(0, len(starts), BLOCK):
        first, size = starts[lo : lo + BLOCK], (ends - starts)[lo : lo + BLOCK]
        chunks = np.maximum(1, (size + 7) >> 3)
        if chunks.max() == 1:
            h = windows[first].view(U).ravel() & _FIRST[size]
            h = mix(mix(h) + GOLD + salt)
        elif chunks.sum() > 4 * BLOCK and len(first) > 1:  # long words: fewer at once
            half = len(first) // 2
            out[lo : lo + half] = span_hashes(data, first[:half], first[:half] + size[:half], seed)
            out[lo + half : lo + len(first)] = span_hashes(data, first[half:], first[half:] + size[half:], seed)
            continue
        else:
            before = np.cumsum(chunks) - chunks
            nth = np.arange(chunks.sum()) - np.repeat(before, chunks)
            left = np.minimum(8, np.repeat(size, chunks) - 8 * nth)
            h = windows[np.repeat(first, chunks) + 8 * nth].view(U).ravel() & _FIRST[left]
            h = np.add.reduceat(mix(mix(h) + (nth + 1).astype(U) * GOLD + salt), before)
        out[lo : lo + BLOCK] = mix(h + size.astype(U) * MIX1)
    return out


def hash_of(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int, seed: int = 0) -> list[np.ndarray]:
    """For each text its sorted distinct word shingles as hashes; a shorter text's whole sequence is one shingle."""
    data = LOWER[data]
    starts, ends, of = spans(data, at, SPACES)
    h = span_hashes(data, starts, ends, seed)
    run, short = mix(h + GOLD), {}
    for j in range(1, width):
        short |= {int(i): run[of[i]] ^ U(j) for i in np.flatnonzero(np.diff(of) == j)}
        run = mix(run[:-1] * BASE + h[j:])
    out = []
    for i in range(len(at) - 1):
        lo, hi = of[i], of[i + 1] - width + 1
        out.append(np.unique(run[lo:hi]) if hi > lo else np.array([short[i]] if i in short else [], U))
    return out
