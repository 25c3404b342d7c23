"""Sharded minimal perfect hashing over 128-bit keys, as NumPy arrays that a table row can hold."""

from __future__ import annotations

import numpy as np

from siltstone.llm.kernels import mix

#: Bits a level gets for each key that it has to place.
SPREAD = 2
LEVELS = 40
_TURN = 0x9E3779B97F4A7C15


def _slot(h1: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix(h1 + np.uint64((level + 1) * _TURN % 2**64)) % np.uint64(size)


class PerfectHash:
    """Each key has an index of its own below ``n``. A key is placed on the first level where no other
    remaining key has its slot; its index is the rank of that bit. Keys that share all slots to the last
    level (equal first halves) come last, sorted, and are found by bisection."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        left, sizes, levels = np.arange(len(h1)), [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-SPREAD * len(left) // 64) * 64
            slot = _slot(h1[left], level, size)
            alone = np.bincount(slot.astype(np.int64), minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[slot.astype(np.int64)]]
        rest = np.zeros(len(left), [("h1", np.uint64), ("h2", np.uint64)])
        rest["h1"], rest["h2"] = h1[left], h2[left]
        rest.sort()
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, np.uint64), rest)

    def index(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Indices of keys; of what isn't a key, any index or -1."""
        out, left = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                return out
            at = self.starts[level] + _slot(h1[left], level, size).astype(np.int64)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.ranks[at >> 6] + below)[hit]
            left = left[~hit]
        if len(left) and len(self.rest):
            key = np.zeros(len(left), self.rest.dtype)
            key["h1"], key["h2"] = h1[left], h2[left]
            # structured arrays have no searchsorted in h1, h2 order on all platforms: bisect on h1, then scan its few equals
            at = np.searchsorted(self.rest["h1"], key["h1"])
            for step in range(len(self.rest)):
                near = np.minimum(at + step, len(self.rest) - 1)
                open_ = (at + step < len(self.rest)) & (self.rest["h1"][near] == key["h1"])
                if not open_.any():
                    break
                same = open_ & (self.rest["h2"][near] == key["h2"])
                out[left[same]] = self.ranks[-1] + near[same]
        return out


class Shards:
    """Fingerprint and count arrays behind one perfect hash for each shard."""

    def __init__(self, n_shards: int, rows: list):
        self.n_shards, self.of = n_shards, {}
        for r in rows:
            ph = PerfectHash(np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["bits"], np.uint64), np.frombuffer(r["rest"], [("h1", np.uint64), ("h2", np.uint64)]))
            self.of[r["shard"]] = ph, np.frombuffer(r["fingerprints"], np.uint64), np.frombuffer(r["counts"], np.uint32)

    def count(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Counts of keys; 0 for what no shard here has."""
        out = np.zeros(len(h1), np.int64)
        if not len(h1):
            return out
        shard = shard_of(h1, self.n_shards)
        order = np.argsort(shard, kind="stable")
        found, first = np.unique(shard[order], return_index=True)
        for s, a, b in zip(found.tolist(), first, [*first[1:], len(order)], strict=True):
            if s in self.of:
                ph, fingerprints, counts = self.of[s]
                own = order[a:b]
                at = ph.index(h1[own], h2[own])
                ok = at >= 0
                ok[ok] = fingerprints[at[ok]] == h2[own][ok]
                out[own[ok]] = counts[at[ok]]
        return out


def shard_of(h1: np.ndarray, n_shards: int) -> np.ndarray:
    return (mix(h1 ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(n_shards)).astype(np.int64)


def shard_arrays(h1: np.ndarray, h2: np.ndarray, counts: np.ndarray) -> dict[str, bytes]:
    """What Shards reads, for the distinct keys of one shard."""
    ph = PerfectHash.build(h1, h2)
    at = ph.index(h1, h2)
    fingerprints, by_index = np.zeros(len(h1), np.uint64), np.zeros(len(h1), np.uint32)
    fingerprints[at], by_index[at] = h2, np.minimum(counts, 2**32 - 1)
    return {"sizes": ph.sizes.tobytes(), "bits": ph.bits.tobytes(), "rest": ph.rest.tobytes(), "fingerprints": fingerprints.tobytes(), "counts": by_index.tobytes()}
