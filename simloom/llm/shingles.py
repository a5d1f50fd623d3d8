"""Word shingles of whole texts as sets of 64-bit hashes, and their fast similarity sketches.

The sketch follows Dahlgaard, Knudsen and Thorup (Fast Similarity Sketching, 2017): in each of the first t
rounds every element is hashed to one of t bins with a value that grows with the round, and a bin keeps its
least value; in round t + k every element goes to bin k. It stops with the first round after which all bins are
filled, so large sets need one or two rounds and no bin ever stays empty.
"""

from __future__ import annotations

import numpy as np
import xxhash

from simloom.llm import worker

WIDTH = 5

_U = np.uint64


def constants(seed: int, n: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers."""
    return np.array([xxhash.xxh64_intdigest(f"{seed}:{k}") | 1 for k in range(n)], dtype=_U)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


class _Words(dict):
    """Hashes of recent words."""

    def __missing__(self, w: bytes) -> bytes:
        h = self[w] = xxhash.xxh64_digest(w)
        return h


_JOIN = constants(11, WIDTH)


def shingles(text: str | bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of a text; fewer words make one shingle; none, none.

    Words are runs of anything but blanks, tabs, line and page breaks, with A to Z in lower case. On UTF-8
    bytes that is what ``lower`` and ``split`` do.
    """
    raw = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").lower()
    words = raw.split()
    if not words:
        return np.empty(0, dtype=_U)
    hashes = worker.kept("shingles", _Words)
    if len(hashes) > 200_000:
        hashes.clear()
    h = np.frombuffer(b"".join(map(hashes.__getitem__, words)), dtype=">u8").astype(_U)
    n = max(1, len(h) - WIDTH + 1)
    out = np.full(n, _U(min(len(h), WIDTH)), dtype=_U)
    for k in range(min(len(h), WIDTH)):
        out += h[k : k + n] * _JOIN[k]
    return np.unique(mix(out))


def sketches(sets: list[np.ndarray], t: int, seed: int = 1) -> np.ndarray:
    """Sketches of non-empty sets, one row of ``t`` 64-bit values each."""
    m = len(sets)
    out = np.full(m * t, np.iinfo(_U).max, dtype=_U)
    flat = np.concatenate(sets) if m else np.empty(0, dtype=_U)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    seeds = constants(seed, 2 * t)
    live = np.ones(m, dtype=bool)
    for k in range(2 * t):
        h = mix(flat ^ seeds[k])
        # The low 48 bits are the value within the round, the others choose the bin.
        bins = ((h >> _U(48)) * _U(t) >> _U(16)).astype(np.int64) if k < t else np.full(len(h), k - t)
        np.minimum.at(out, owner * t + bins, _U(k << 48) | (h & _U((1 << 48) - 1)))
        full = (out.reshape(m, t) != np.iinfo(_U).max).all(1)
        if full.all():
            break
        if (live & full).any():
            live &= ~full
            stay = live[owner]
            flat, owner = flat[stay], owner[stay]
    return out.reshape(m, t)


def bands(sketch: np.ndarray, rows: int, seed: int = 2) -> np.ndarray:
    """A 64-bit key of each band of ``rows`` coordinates, different bands having different keys."""
    m, t = sketch.shape
    n = t // rows
    c = constants(seed, rows)
    h = np.broadcast_to(np.arange(1, n + 1, dtype=_U) << _U(40), (m, n)).copy()
    for k in range(rows):
        h = mix(h ^ mix(sketch[:, k::rows][:, :n] * c[k]))
    return h
