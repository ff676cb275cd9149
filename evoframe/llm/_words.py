"""Words of texts as 64-bit hashes, by numpy alone: no table of words is kept.

Words are what white space of ASCII parts (space and bytes 9 to 13). A word's hash is made
from its bytes, eight at a time, all words of a block at once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 22

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: By how many of eight bytes are a word's: the bits to keep.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def hash_spans(raw: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of the bytes from each start to its end."""
    eights = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), strides=(1,))
    out = mixed((ends - starts).astype(np.uint64) + np.uint64(seed))
    todo, at = np.arange(len(starts)), starts
    while len(todo):
        left = ends[todo] - at
        out[todo] = mixed(out[todo] + (eights[at] & _KEEP[np.minimum(left, 8)]))
        more = left > 8
        todo, at = todo[more], at[more] + 8
    return out


def _hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of a block, and where it starts."""
    edge = np.ones(len(raw) + 2, bool)
    edge[1:-1] = _SPACE[np.frombuffer(raw, np.uint8)]
    turns = np.flatnonzero(edge[1:] != edge[:-1])
    return hash_spans(raw, turns[::2], turns[1::2]), turns[::2]


def word_hashes(raw: bytes) -> np.ndarray:
    """The hash of each word, in their order; a text longer than ``BLOCK`` is cut at white space."""
    if len(raw) <= BLOCK:
        return _hashes(raw)[0]
    parts, at = [], 0
    while at < len(raw):
        end = at + BLOCK
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        parts.append(_hashes(raw[at:end])[0])
        at = end
    return np.concatenate(parts)


def words_of_each(raws: list[bytes]) -> list[np.ndarray]:
    """``word_hashes`` of many texts, made together while they are short."""
    if sum(map(len, raws)) > BLOCK:
        return [word_hashes(raw) for raw in raws]
    found, starts = _hashes(b" ".join(raws))
    lengths = np.array([len(raw) for raw in raws], np.int64)
    return np.split(found, np.searchsorted(starts, np.cumsum(lengths + 1)[:-1])) if raws else []
