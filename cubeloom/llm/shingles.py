"""Sets of word shingles as sorted 64-bit hashes, computed for a batch of texts at a time."""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the first byte's place of each word (a run without the six white-space characters)."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = _SPACE[b]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    sizes = np.diff(np.append(starts, len(b)))
    place = np.arange(starts[0], len(b)) - np.repeat(starts, sizes)
    # bytes of very long words share places after 4096, told apart by their block
    part = _BYTE[b[starts[0] :]] * _PLACE[place & 4095]
    if place.max() > 4095:
        part = mixed(part + (place >> 12).astype(np.uint64))
    part[space[starts[0] :]] = 0
    return mixed(np.add.reduceat(part, starts - starts[0])), starts


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Each text's set of ``k``-word shingles after lower-casing A-Z: sorted hashes. A text of fewer words, but not none,
    has its whole sequence as its one shingle; a text without words has none."""
    raws = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    words, starts = word_hashes(b" ".join(raws))
    ends = np.cumsum([len(r) + 1 for r in raws])
    bounds = np.concatenate([[0], np.searchsorted(starts, ends)])
    if len(words) >= k:
        joined = sum(words[j : len(words) - k + 1 + j] * _WORD[j] for j in range(k))
        joined = mixed(joined + np.uint64(k))
    else:
        joined = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(joined[a : b - k + 1]))
        elif b > a:
            whole = (words[a:b] * _WORD[k : k + b - a]).sum() + np.uint64(1000 + b - a)
            out.append(mixed(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def overlaps(pivot: np.ndarray, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of ``pivot``'s hashes each of the sets in ``flat`` (set i from ``bounds[i]`` to ``bounds[i + 1]``, none
    empty) has."""
    at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
    return np.add.reduceat((pivot[at] == flat).astype(np.int64), bounds[:-1])
