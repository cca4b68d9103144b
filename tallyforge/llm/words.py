"""Hashes of all words of a text, computed over whole arrays."""

from __future__ import annotations

import numpy as np

_SEGMENT = 1 << 21
_STEP, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, dtype=bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_marks = _space.copy()
_marks[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, 1 << 14), base, dtype=np.uint64)
        steps[0] = 1
        _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers[key][:n]


def _of_segment(data: np.ndarray, between: np.ndarray) -> np.ndarray:
    space = between[data]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    if not len(edge):
        return np.empty(0, dtype=np.uint64)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_lower[data].astype(np.uint64) + np.uint64(1)) * _power(_STEP, len(data)), out=sums[1:])
    starts, ends = edge[::2], edge[1::2]
    return mix((sums[ends] - sums[starts]) * _power(_BACK, len(data))[starts])


def word_hashes(text: bytes, marks: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, in order; words lie between ASCII white space, and A-Z count as a-z.

    With `marks`, ASCII punctuation lies between words too.
    """
    data, between = np.frombuffer(text, dtype=np.uint8), _marks if marks else _space
    if len(data) <= _SEGMENT:
        return _of_segment(data, between)
    out, at = [], 0
    while at < len(data):
        end = min(at + _SEGMENT, len(data))
        while end < len(data) and not between[data[end]]:
            end += 1
        out.append(_of_segment(data[at:end], between))
        at = end
    return np.concatenate(out)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words in a row."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(0x100000001B3) + hashes[k : len(hashes) - n + 1 + k]
    return mix(out)
