"""A minimal perfect hash of 64-bit keys in numpy: bit levels with collisions passed on."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bits of a level for each key that reaches it.
ROOM = 2


def scattered(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixing of the keys, another one for every seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(2 * seed + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class PerfectHash:
    """``sizes`` of the levels in bits, and their ``bits``; a key's slot is the rank of its bit."""

    sizes: tuple[int, ...]
    bits: bytes

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """Keys alone on their bit of a level stay there, the others go on to the next."""
        sizes, levels, rest = [], [], np.unique(keys)
        while len(rest):
            size = max(64, ROOM * len(rest))
            at = (scattered(rest, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            rest = rest[~alone[at]]
        flat = np.concatenate(levels) if levels else np.zeros(0, bool)
        return cls(tuple(sizes), np.packbits(flat).tobytes())

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, 0 to n - 1; keys that were not hashed get any slot or -1."""
        flat = np.unpackbits(np.frombuffer(self.bits, np.uint8))[: sum(self.sizes)].astype(bool)
        rank = np.cumsum(flat, dtype=np.int64) - 1
        found = np.full(len(keys), -1, np.int64)
        open_, base = np.arange(len(keys)), 0
        for seed, size in enumerate(self.sizes):
            at = base + (scattered(keys[open_], seed) % np.uint64(size)).astype(np.int64)
            here = flat[at]
            found[open_[here]] = rank[at[here]]
            open_, base = open_[~here], base + size
        return found


def verified(hashed: PerfectHash, slot_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The slots of keys, -1 for a key that is not the one its slot was made for."""
    if not len(slot_keys):
        return np.full(len(keys), -1, np.int64)
    slots = hashed.slots(keys)
    return np.where((slots >= 0) & (slot_keys[slots] == keys), slots, -1)
