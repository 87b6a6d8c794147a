import random

import numpy as np
import pytest
import xxhash

from pagetables.llm.simhash_groups import Tiling, _cell, fingerprint, linked, near_groups, one_of_each
from tests.llm.data import DOCS, awkward, awkward_rows, empty, prose


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    if not words:
        return 0
    n = max(1, len(words) - 3)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > n)


def plain_groups(rows):
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 4 and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    least = {}
    for g, (d, *_) in zip(group, rows, strict=True):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return sorted(
        ((d, f"{f:016x}", least.get(g)) for (d, *_), f, g in zip(rows, fps, group, strict=True)), key=str
    )


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def some_rows():
    rng = random.Random(8)
    rows = []
    for i in range(40):
        words = prose(rng, rng.choice((1, 3, 5, 200))).split()
        for j in range(rng.randrange(4)):
            copy = list(words)
            if len(copy) > 100:
                copy[j * 7] = "changed"
            rows.append((1000 - i * 5 - j, " ".join(copy).title(), "en", "s", 1))
    return rows


@pytest.mark.parametrize("tile_rows", [3, 8192])
def test_equals_brute_force(spark, tile_rows):
    rows = some_rows()
    frame = spark.createDataFrame(rows, DOCS)
    assert got(near_groups(frame, tile_rows=tile_rows)) == plain_groups(rows)


def test_awkward_rows(spark):
    assert got(near_groups(awkward(spark))) == plain_groups(awkward_rows())
    assert near_groups(empty(spark)).collect() == []


def test_one_of_each_keeps_the_smallest(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 100), "en", "s", 1) for i in range(20)]
    rows += [(100 + i, t.upper().replace(" ", "\t "), *rest) for i, t, *rest in rows[:9]]
    kept = one_of_each(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(20))
    # Rows without an id cannot be the smallest of a group, and stay.
    ids = sorted((r["doc_id"] for r in one_of_each(awkward(spark)).collect()), key=str)
    groups = plain_groups(awkward_rows())
    assert ids == sorted((d for d, _, least in groups if d is None or d == least), key=str) and 7 not in ids and 2 not in ids
    assert one_of_each(empty(spark)).collect() == []


def test_hash_is_sparks_own(spark):
    from pyspark.sql import functions as F

    text = "one word only"
    value = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % (1 << 64)
    assert fingerprint(text.encode()) == value


@pytest.mark.parametrize("n", [1, 50, 700])
def test_tiles_lose_no_link(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, n, np.uint64)
    bits = np.uint64(1) << rng.integers(0, 64, (3, n)).astype(np.uint64)
    fps = np.unique(np.concatenate((base, base ^ bits[0] ^ bits[1], base ^ bits[0] ^ bits[1] ^ bits[2])))
    counts = dict(zip(*(x.tolist() for x in np.unique(_cell(fps), return_counts=True)), strict=True))
    tiling = Tiling(counts, 4, tiles=9, rows=5)
    tile = tiling.tile(fps)
    sides = {}
    for fp, t in zip(fps, tile, strict=True):
        for pair, side in tiling.pairs[t]:
            sides.setdefault(pair, ([], []))[side].append(fp)
    both = {p for each in tiling.pairs for p, s in each if s}
    links = set()
    for pair, (a, b) in sides.items():
        a, b = np.array(a, np.uint64), np.array(b, np.uint64)
        if pair not in both:
            b = None
        elif not len(a) or not len(b):
            continue
        links |= set(zip(*(x.tolist() for x in linked(a, b, 4)), strict=True))
    assert all((a ^ b).bit_count() <= 64 for a, b in links)

    def groups(pairs):
        root = {int(f): int(f) for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return {f: find(f) for f in root}

    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    exact = [(int(fps[i]), int(fps[j])) for i, j in zip(*np.nonzero(close), strict=True)]
    assert groups(links) == groups(exact)
