import hashlib
import random

import numpy as np

from pagetables.llm.suffix_dedup import WIDTH, SuffixFamily, remove_repeats, stretches
from tests.llm.data import DOCS, awkward, awkward_rows, empty, prose


def brute(rows):
    """(id, bytes removed, runs, digest) of every row."""
    last = max((d for d, *_ in rows if d is not None), default=0) + 1
    docs = [(last if d is None else d, (t or "").encode()) for d, t, *_ in rows]
    least = {}
    for d, b in docs:
        for p in range(len(b) - WIDTH + 1):
            s = b[p : p + WIDTH]
            least[s] = min(least.get(s, d), d)
    out = []
    for (d, b), (given, *_) in zip(docs, rows, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - WIDTH + 1):
            if least[b[p : p + WIDTH]] < d:
                gone[p : p + WIDTH] = b"\1" * WIDTH
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((given, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.drop("kept").collect()), key=str)


def test_equals_brute_force_on_shared_passages(spark):
    rng = random.Random(3)
    line, passage = prose(rng, 12), prose(rng, 70)
    rows = []
    for i in range(60):
        text = prose(rng, rng.randrange(80))
        if i % 3 == 0:
            text += "\n" + line + "\n" + prose(rng, 10)
        if i % 7 == 0:
            text = prose(rng, 5) + passage[i : 300 + i] + text
        if i % 11 == 0:
            text += "ab" * 90
        rows.append((rng.randrange(1000) if i % 13 else None, text, "en", "s", 1))
    frame = spark.createDataFrame(rows, DOCS)
    assert got(remove_repeats(frame, part_bytes=4000)) == brute(rows)
    assert got(remove_repeats(frame)) == brute(rows)


def test_awkward_rows(spark):
    assert got(remove_repeats(awkward(spark), part_bytes=100_000)) == brute(awkward_rows())
    assert remove_repeats(empty(spark)).collect() == []


def test_kept_bytes_are_what_is_left(spark):
    rows = [(1, "x" * 60, "", "", 0), (2, "start " + "x" * 55 + " end", "", "", 0)]
    kept = {r["doc_id"]: bytes(r["kept"]) for r in remove_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept == {1: b"x" * 60, 2: b"start  end"}


def test_stretches_hold_every_window_once(monkeypatch):
    monkeypatch.setattr("pagetables.llm.suffix_dedup.CHUNK", 64)
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 1000).astype(np.uint8)
    offsets = np.array([0, 10, 10, 300, 349, 1000])
    row, start, size, _ = stretches(data, offsets)
    windows = [(r, s + i) for r, s, n in zip(row, start, size, strict=True) for i in range(n)]
    expected = [(r, p) for r in range(5) for p in range(offsets[r], offsets[r + 1] - WIDTH + 1)]
    assert windows == expected


def test_levels_merge_geometrically():
    family = SuffixFamily()
    for i in range(64):
        values = np.array([f"{i:03d}{j:04d}".encode().ljust(WIDTH, b".") + b"\1" for j in range(100)])
        assert not family.scan(values, np.full(100, i)).any()
        assert family.scan(values, np.full(100, 1000)).all()
    sizes = [len(level) for level in family.levels]
    assert sum(sizes) == 6400 and len(sizes) <= 7
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
