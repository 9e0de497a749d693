"""Hashed word shingles of a whole column of texts at once, in numpy.

Words are maximal runs of anything but the six ASCII blanks, with A-Z lower-cased. A word's hash is a polynomial over
a random value for each of its bytes, read off running sums; a shingle's mixes those of its words. All are 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype="uint64")
_BYTE[65:91] = _BYTE[97:123]
_BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_BYTE[_BLANK] = 0
#: An odd base, 3 modulo 4, and its inverse modulo 2 ** 64.
_BASE = (int(_RANDOM.integers(1, 2**62, dtype="uint64")) << 2) | 3
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that are hashed together; powers of the base are kept for so many.
PIECE = 1 << 20


def _powers(base: int) -> np.ndarray:
    out = np.ones(PIECE + 1, "uint64")
    n = 1
    with np.errstate(over="ignore"):
        while n <= PIECE:
            m = min(n, PIECE + 1 - n)
            out[n : n + m] = out[:m] * np.uint64(pow(base, n, 2**64))
            n += m
    return out


_POWERS, _BACK = _powers(_BASE), _powers(_INVERSE)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a buffer; no word goes on over a place in ``first``."""
    solid = ~_BLANK[data]
    opens, closes = solid.copy(), solid.copy()
    cut = np.zeros(len(data), bool)
    cut[first[first < len(data)]] = True
    opens[1:] &= ~solid[:-1] | cut[1:]
    closes[:-1] &= ~solid[1:] | cut[1:]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = np.zeros(len(starts), "uint64")
    with np.errstate(over="ignore"):
        at = 0
        while at < len(starts):
            base = starts[at]
            last = max(at + 1, int(np.searchsorted(ends, base + PIECE, "right")))
            stop = ends[last - 1]
            if stop - base <= PIECE:
                sums = np.cumsum(_BYTE[data[base:stop]] * _POWERS[: stop - base])
                sums = np.concatenate([np.zeros(1, "uint64"), sums])
                s, e = starts[at:last] - base, ends[at:last] - base
                hashes[at:last] = (sums[e] - sums[s]) * _BACK[s]
            else:  # one word longer than a piece
                whole = np.uint64(0)
                for i in range(base, stop, PIECE):
                    part = data[i : min(i + PIECE, stop)]
                    whole = whole * np.uint64(0xD6E8FEB86659FD93) + (_BYTE[part] * _POWERS[: len(part)]).sum(dtype="uint64")
                hashes[at] = whole
            at = last
        return starts, mixed(hashes + (ends - starts).astype("uint64") * _STEP)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; of its whole sequence, if it has fewer words; none, if it has no words or is null."""
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return []
    offsets = np.frombuffer(texts.buffers()[1], "int64")[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, "uint8")[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, "uint8")
    bounds = offsets - offsets[0]
    starts, h = _word_hashes(data, bounds[:-1]) if len(data) else (np.zeros(0, "int64"), np.zeros(0, "uint64"))
    edges = np.searchsorted(starts, bounds)
    with np.errstate(over="ignore"):
        whole = np.zeros(max(len(h) - words + 1, 0), "uint64")
        for i in range(words if len(whole) else 0):
            whole = whole * _STEP + h[i : i + len(whole)]
        whole = mixed(whole + np.uint64(words))
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a >= words:
                s = np.sort(whole[a : b - words + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
            elif b > a:
                one = np.zeros(1, "uint64")
                for i in range(a, b):
                    one = one * _STEP + h[i]
                out.append(mixed(one + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, "uint64"))
    return out
