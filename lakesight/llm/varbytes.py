"""Byte-aligned variable-length coding of ranks: 2-bit lengths in control bytes, then 1 to 4 data bytes each."""

from __future__ import annotations

import numpy as np

_CHUNK = 1 << 14  # values at a time, so that they stay in the processor's cache
_CONTROL = np.arange(256)
#: bytes taken by each of the four values of a control byte
LENGTHS = np.stack([(_CONTROL >> 2 * i & 3) + 1 for i in range(4)], axis=1).astype(np.uint8)


def ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids by falling frequency, then by id; each id's rank in that list)."""
    times = np.bincount(ids)
    by = np.argsort(-times, kind="stable")[: np.count_nonzero(times)].astype(np.uint32)
    rank = np.zeros(len(times), dtype=np.uint32)
    rank[by] = np.arange(len(by), dtype=np.uint32)
    return by, rank[ids]


def _encoded(ranks: np.ndarray) -> tuple[bytes, bytes]:
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    padded[: len(ranks)] = extra
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    used = np.arange(4, dtype=np.uint8)[None, :] <= extra[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    parts = [_encoded(ranks[at : at + _CHUNK]) for at in range(0, len(ranks), _CHUNK)]
    return b"".join(c for c, _ in parts), b"".join(d for _, d in parts)


def decode(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values of ``encode``: table lookups give every value's width, and byte reads at its place its value."""
    control = np.frombuffer(control, dtype=np.uint8)
    padded = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    out, at = np.empty(count, dtype=np.uint32), 0
    for first in range(0, count, _CHUNK):
        lengths = LENGTHS[control[first // 4 : (first + _CHUNK) // 4]].ravel()[: count - first]
        starts = np.cumsum(lengths, dtype=np.int64) - lengths + at
        at = int(starts[-1]) + int(lengths[-1])
        values = padded[starts].astype(np.uint32)
        for width in (1, 2, 3):
            longer = np.flatnonzero(lengths > width)
            if not len(longer):
                break
            values[longer] |= padded[starts[longer] + width].astype(np.uint32) << np.uint32(8 * width)
        out[first : first + len(values)] = values
    return out
