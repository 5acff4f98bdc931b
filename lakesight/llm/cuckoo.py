"""Cuckoo filters: sets of 64-bit hashes with insertion and deletion, as arrays of marks of up to 16 bits."""

from __future__ import annotations

import numpy as np

SLOTS = 4
MARK_BITS = 16
MAX_LOAD = 0.8
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _M1
    x = (x ^ x >> np.uint64(27)) * _M2
    return x ^ x >> np.uint64(31)


class CuckooFilter:
    """A key's mark lies in one of two buckets; either follows from the other and the mark, so it can be moved or removed."""

    def __init__(self, buckets: int, mark_bits: int = MARK_BITS):
        self.mark_bits = mark_bits
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint16)  # 0: free; the number of buckets is a power of two

    @classmethod
    def for_keys(cls, number: int, mark_bits: int = MARK_BITS) -> CuckooFilter:
        buckets = 4
        while buckets * SLOTS * MAX_LOAD < number:
            buckets *= 2
        return cls(buckets, mark_bits)

    @classmethod
    def from_bytes(cls, data: bytes, mark_bits: int = MARK_BITS) -> CuckooFilter:
        out = cls(0, mark_bits)
        out.table = np.frombuffer(data, dtype="<u2").reshape(-1, SLOTS).copy()
        return out

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def __len__(self) -> int:
        return int(np.count_nonzero(self.table))

    def room(self, number: int) -> bool:
        return len(self) + number <= self.table.size * MAX_LOAD

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = _mixed(keys.astype(np.uint64))
        mark = (keys >> np.uint64(64 - self.mark_bits)).astype(np.uint16)
        mark[mark == 0] = 1
        return (keys & np.uint64(len(self.table) - 1)).astype(np.int64), mark

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (_mixed(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """True for every key inserted; wrongly true for about one other key in 8,000 with marks of 16 bits."""
        bucket, mark = self._places(keys)
        here, there = self.table[bucket], self.table[self._other(bucket, mark)]
        return ((here == mark[:, None]) | (there == mark[:, None])).any(axis=1)

    def _place(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Put marks into free slots of their buckets; True where there was one."""
        by = np.argsort(bucket, kind="stable")
        b = bucket[by]
        start = np.concatenate([[True], b[1:] != b[:-1]])
        nth = np.arange(len(b)) - np.maximum.accumulate(np.where(start, np.arange(len(b)), 0))
        free = self.table[b] == 0
        fits = nth < free.sum(axis=1)
        slot = np.argmax(np.cumsum(free, axis=1) == (nth + 1)[:, None], axis=1)
        self.table[b[fits], slot[fits]] = mark[by[fits]]
        placed = np.zeros(len(bucket), dtype=bool)
        placed[by[fits]] = True
        return placed

    def insert(self, keys: np.ndarray, seed: int = 1) -> bool:
        """Insert keys not inserted before. False if no room was found; the filter must then be built anew, larger."""
        bucket, mark = self._places(keys)
        random = np.random.default_rng(seed)
        for turn in range(500):
            if not len(bucket):
                return True
            placed = self._place(bucket, mark)
            bucket, mark = bucket[~placed], mark[~placed]
            if not turn:
                bucket = self._other(bucket, mark)
            elif len(bucket):
                # throw out one mark per full bucket; it goes to its other bucket
                _, one = np.unique(bucket, return_index=True)
                slot = random.integers(0, SLOTS, len(one))
                out = self.table[bucket[one], slot]
                self.table[bucket[one], slot] = mark[one]
                rest = np.ones(len(bucket), dtype=bool)
                rest[one] = False
                thrown = out != 0
                bucket = np.concatenate([bucket[rest], self._other(bucket[one][thrown], out[thrown])])
                mark = np.concatenate([mark[rest], out[thrown]])
        return False

    def remove(self, keys: np.ndarray) -> None:
        """Remove keys that were inserted, one mark each. A key without a mark is an error, and no other mark goes for it."""
        bucket, mark = self._places(keys)
        while len(bucket):
            other = self._other(bucket, mark)
            where = np.where((self.table[bucket] == mark[:, None]).any(axis=1), bucket, other)
            if not (self.table[where] == mark[:, None]).any(axis=1).all():
                raise KeyError("a key to be removed has no mark")
            slot = np.argmax(self.table[where] == mark[:, None], axis=1)
            # equal marks of one bucket go one after the other
            _, one = np.unique(where * 65536 + mark, return_index=True)
            self.table[where[one], slot[one]] = 0
            rest = np.ones(len(bucket), dtype=bool)
            rest[one] = False
            bucket, mark = bucket[rest], mark[rest]
