"""Exact removal of repeated 50-byte strings with a logarithmic family of suffix arrays.

Texts are UTF-8 bytes.  Every 50-byte string has a key: the least hash among its 16-byte
grams.  Equal strings have equal keys, and neighbouring strings mostly share one, so a
text falls into *stretches*: runs of windows with the same key.

1. ``repeated_keys`` finds the keys that more than one text holds.  Every task sends
   five bytes for each of its distinct keys.
2. The stretches of these keys go to the bucket of their key, with their bytes.
3. ``SuffixFamily`` takes a bucket in batches of ascending ``doc_id``.  A batch gets a
   suffix array over its windows, which is scanned against the sorted levels that exist;
   then it becomes a level, and levels of like size merge, so that a suffix is merged
   O(log n) times.
4. The covered windows go back to the part of their text.

A text is never a shuffle key, a part or bucket holds a bounded share of the bytes, and
no step depends on how many copies a passage has: a task sends a stretch that several of
its texts hold only once, for the least of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.llm.common import from_planes, part_of, parts_for, pick, planes, runs, utf8

WIDTH = 50
GRAM = 16
#: Windows in a stretch at most; longer runs, as of one repeated letter, are split.
LONGEST = 64
#: Bytes of text hashed at once.
CHUNK = 1 << 20
#: Keys that a task gathers before it sends them.
FLUSH = 2_000_000
#: Windows that make a batch of the suffix family.
BATCH = 32_768
#: Key bits that are sent; the bucket adds its own.
BITS = 40
#: Bytes of text in a part and in a bucket.
PART_BYTES = 8 << 20

LAST_DOC = np.iinfo(np.int64).max
_NOWHERE = (1 << 24) - 1
_MULT = [np.uint64(pow(0x9E3779B97F4A7C15, 1 << i, 1 << 64)) for i in range(4)]
_LETTER = np.random.default_rng(50).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)

ROWS = "kind int, k int, blob binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def window_keys(data: np.ndarray) -> np.ndarray:
    """For every window of ``WIDTH`` bytes the least hash of its ``GRAM``-byte grams."""
    if len(data) < WIDTH:
        return np.zeros(0, np.uint64)
    h, step = _LETTER[data], 1
    for mult in _MULT:
        h = h[:-step] * mult + h[step:]
        step *= 2
    h, span, step = _mixed(h), WIDTH - GRAM + 1, 1
    while step * 2 <= span:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[: len(h) - (span - step)], h[span - step :]) if span > step else h


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first window, number of windows, key) of all stretches, in order."""
    out, n, first = [], len(data), 0
    while first <= n - WIDTH:
        last = min(n, first + CHUNK + WIDTH - 1)
        keys = window_keys(data[first:last])
        bounds = np.flatnonzero(keys[1:] != keys[:-1]) + 1 + first
        inner = offsets[(offsets > first) & (offsets < first + len(keys))]
        start = np.unique(np.concatenate(([first], bounds, inner)))
        row = np.searchsorted(offsets, start, "right") - 1
        end = np.append(start[1:], first + len(keys))
        size = np.minimum(end, offsets[row + 1] - WIDTH + 1) - start
        keep = size > 0
        start, row, size = start[keep], row[keep], size[keep]
        pieces = (size + LONGEST - 1) // LONGEST
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        key = np.repeat(keys[start - first], pieces)
        row, size = np.repeat(row, pieces), np.repeat(size, pieces) - nth * LONGEST
        start = np.repeat(start, pieces) + nth * LONGEST
        out.append((row, start, np.minimum(size, LONGEST), _mixed(key)))
        first += CHUNK
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _bucketed(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each key, and bucket and low bits in one number."""
    bucket = (keys >> np.uint64(BITS)) % np.uint64(buckets)
    return bucket.astype(np.int64), (bucket << np.uint64(BITS)) | (keys & np.uint64((1 << BITS) - 1))


def _rows(kind: int, k: np.ndarray, sort: bool, make) -> list[tuple[int, int, bytes]]:
    """One row for each value of k; ``make`` gets the indexes of its entries."""
    order = np.argsort(k, kind="stable") if sort else np.arange(len(k))
    at = runs(k[order])
    return [(kind, int(k[order[a]]), make(order[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kind, k, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), pa.array(k, pa.int32()), pa.array(blob, pa.binary())],
        ["kind", "k", "blob"],
    )


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)])


def _sent_keys(key, doc, part, buckets: int) -> pa.RecordBatch:
    """What one task sends of its keys.

    A key that two of its texts hold is known to be repeated: it is told to their parts at
    once, and its bucket gets it twice, without a part.
    """
    order = np.lexsort((doc, key))
    key, doc, part = key[order], doc[order], part[order]
    new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))
    key, part = key[new], part[new]
    at = runs(key)
    many = np.repeat(np.diff(at) > 1, np.diff(at))
    bucket, whole = _bucketed(key, buckets)
    told = np.unique(np.stack((part[many], whole[many].astype(np.int64))), axis=1)
    twice = at[:-1][np.diff(at) > 1]
    at = np.concatenate((np.flatnonzero(~many), twice, twice))
    to = np.where(many[at], _NOWHERE, part[at])
    low, bucket = whole[at], bucket[at]

    def blob(i):
        return planes(low[i], 5) + planes(to[i], 3)

    return _batch(
        _rows(0, bucket, True, blob)
        + _rows(1, told[0], False, lambda i: planes(told[1][i].astype(np.uint64), 8))
    )


def _find_keys(buckets: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, rows_before = [], 0, 0
        for batch in batches:
            data, offsets = utf8(batch["text"])
            row, _, _, key = stretches(data, offsets)
            part = batch["part"].to_numpy(zero_copy_only=False)
            held.append((key, row + rows_before, part[row].astype(np.int64)))
            n += len(key)
            rows_before += batch.num_rows
            if n >= FLUSH:
                yield _sent_keys(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets)
                held, n = [], 0
        if n:
            yield _sent_keys(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets)

    return find


def _count_keys(group: pa.Table) -> pa.Table:
    if group["kind"][0].as_py() == 1:
        return group
    bucket = group["k"][0].as_py()
    low, to = [], []
    for raw in group["blob"].to_pylist():
        n = len(raw) // 8
        low.append(from_planes(raw[: 5 * n], 5))
        to.append(from_planes(raw[5 * n :], 3))
    low, to = np.concatenate(low), np.concatenate(to).astype(np.int64)
    order = np.argsort(low, kind="stable")
    low, to = low[order], to[order]
    at = runs(low)
    many = np.repeat(np.diff(at) > 1, np.diff(at)) & (to != _NOWHERE)
    low, to = low[many] | np.uint64(bucket << BITS), to[many]
    return _table(_rows(1, to, True, lambda i: planes(np.unique(low[i]), 8)))


def _in_order(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """Bytes, offsets and ids of a part's texts by id and text; an absent id comes last."""
    docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    data, offsets = utf8(docs["text"])
    ids = docs["doc_id"].combine_chunks().fill_null(int(LAST_DOC)).to_numpy() if len(docs) else np.zeros(0, np.int64)
    return data, offsets, ids, docs


def _take_stretches(buckets: int):
    def take(key, docs: pa.Table, marks: pa.Table) -> pa.Table:
        """The stretches of repeated keys; those a smaller text of the part has are covered."""
        if not len(docs) or not len(marks):
            return _table([])
        part = docs["part"][0].as_py()
        data, offsets, ids, _ = _in_order(docs)
        row, start, size, keys = stretches(data, offsets)
        known = np.unique(np.concatenate([from_planes(x, 8) for x in marks["blob"].to_pylist()]))
        bucket, whole = _bucketed(keys, buckets)
        at = np.minimum(np.searchsorted(known, whole), len(known) - 1)
        hit = np.flatnonzero(known[at] == whole)
        text, first = data.tobytes(), {}
        sent = np.zeros(len(hit), bool)
        for i, (a, b, doc) in enumerate(
            zip(start[hit].tolist(), (start + size)[hit].tolist(), ids[row[hit]].tolist(), strict=True)
        ):
            sent[i] = first.setdefault(text[a : b + WIDTH - 1], doc) == doc
        covered, hit = hit[~sent], hit[sent]
        place = start - offsets[row]
        row_at, size_at = row[hit], size[hit]
        start_at, place_at, whole_at = start[hit], place[hit], whole[hit]

        def blob(i):
            body = b"".join(
                text[a : a + n + WIDTH - 1]
                for a, n in zip(start_at[i].tolist(), size_at[i].tolist(), strict=True)
            )
            head = planes(ids[row_at[i]].astype(np.uint64), 8) + planes(row_at[i], 4)
            head += planes(place_at[i], 4) + planes(size_at[i], 1) + planes(whole_at[i], 8)
            raw = len(i).to_bytes(4, "little") + head + body
            return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)

        rows = [(0, k, part.to_bytes(4, "little") + b) for _, k, b in _rows(0, bucket[hit], True, blob)]
        if len(covered):
            rows.append((1, part, _cover(row[covered], place[covered], size[covered])))
        return _table(rows)

    return take


def _cover(row, place, size) -> bytes:
    return planes(row, 4) + planes(place, 4) + planes(size, 1)


class SuffixFamily:
    """Sorted levels of window suffixes, each with the least text that holds it.

    ``scan`` takes the windows of texts that are all greater than those of earlier calls.
    """

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def scan(self, windows: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Which windows a smaller text has, here or in a level; then adds the new ones."""
        order = np.argsort(windows, kind="stable")  # the batch's suffix array
        suffixes, docs_at = windows[order], docs[order]
        at = runs(suffixes)
        least = np.minimum.reduceat(docs_at, at[:-1]) if len(order) else docs_at
        fresh, known = suffixes[at[:-1]], np.zeros(len(at) - 1, bool)
        for level in self.levels:
            where = np.minimum(np.searchsorted(level, fresh), len(level) - 1)
            known |= level[where] == fresh
        found = np.empty(len(order), bool)
        found[order] = np.repeat(known, np.diff(at)) | (docs_at > np.repeat(least, np.diff(at)))
        if not known.all():
            self.levels.append(fresh[~known])
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            merged = np.concatenate((self.levels.pop(), self.levels.pop()))
            merged.sort(kind="stable")
            self.levels.append(merged)
        return found


def _windows(text: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All windows of the stretches as fixed-width strings; a last letter keeps zero bytes."""
    nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(start, size) + nth
    body = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), WIDTH)[at]
    out = np.ones((len(at), WIDTH + 1), np.uint8)
    out[:, :WIDTH] = body
    return out.view(f"S{WIDTH + 1}").ravel()


def _scan_bucket(group: pa.Table) -> pa.Table:
    if group["kind"][0].as_py() == 1:
        return group
    cols, bodies = [], []
    for packed in group["blob"].to_pylist():
        part, raw = int.from_bytes(packed[:4], "little"), packed[12:]
        raw = pa.decompress(raw, int.from_bytes(packed[4:12], "little"), "zstd", asbytes=True)
        n, at = int.from_bytes(raw[:4], "little"), 4
        got = [np.full(n, part)]
        for width in (8, 4, 4, 1, 8):
            got.append(from_planes(raw[at : at + n * width], width).astype(np.int64))
            at += n * width
        cols.append(got)
        bodies.append(raw[at:])
    part, doc, row, place, size, key = (np.concatenate(x) for x in zip(*cols, strict=True))
    text = b"".join(bodies)
    start = np.cumsum(size + WIDTH - 1) - (size + WIDTH - 1)
    order = np.lexsort((start, doc))
    part, doc, row, place, size, key, start = (x[order] for x in (part, doc, row, place, size, key, start))

    # A stretch whose whole text a smaller text has is covered.  Keys of one stretch only
    # need no finer look; all others go into the suffix arrays window by window.
    first: dict[bytes, int] = {}
    least = np.fromiter(
        (
            first.setdefault(text[a : a + n + WIDTH - 1], d)
            for a, n, d in zip(start.tolist(), size.tolist(), doc.tolist(), strict=True)
        ),
        np.int64,
        len(doc),
    )
    del first
    whole = least < doc
    distinct, where = np.unique(key, return_inverse=True)
    several = np.bincount(where, ~whole, len(distinct))[where] > 1
    covers = [(part[whole], row[whole], place[whole], size[whole])]
    rest = np.flatnonzero(~whole & several)
    family, used = SuffixFamily(), 0
    ends = np.cumsum(size[rest])
    while used < len(rest):
        stop = int(np.searchsorted(ends, (ends[used - 1] if used else 0) + BATCH)) + 1
        while stop < len(rest) and doc[rest[stop]] == doc[rest[stop - 1]]:
            stop += 1
        i, used = rest[used:stop], stop
        windows = _windows(text, start[i], size[i])
        found = family.scan(windows, np.repeat(doc[i], size[i]))
        nth = np.arange(len(windows)) - np.repeat(np.cumsum(size[i]) - size[i], size[i])
        of = np.repeat(i, size[i])
        change = np.append(True, (found[1:] != found[:-1]) | (of[1:] != of[:-1]))
        at = np.flatnonzero(change)
        length = np.diff(np.append(at, len(found)))
        at, length = at[found[at]], length[found[at]]
        covers.append((part[of[at]], row[of[at]], place[of[at]] + nth[at], length))
    part, row, place, size = (np.concatenate(x) for x in zip(*covers, strict=True))
    return _table(_rows(1, part, True, lambda i: _cover(row[i], place[i], size[i])))


def _digest(key, docs: pa.Table, covers: pa.Table) -> pa.Table:
    data, offsets, ids, docs = _in_order(docs)
    change = np.zeros(len(data) + 1, np.int64)
    for raw in covers["blob"].to_pylist():
        n = len(raw) // 9
        row = from_planes(raw[: 4 * n], 4).astype(np.int64)
        start = from_planes(raw[4 * n : 8 * n], 4).astype(np.int64) + offsets[row]
        end = start + from_planes(raw[8 * n :], 1).astype(np.int64) + WIDTH - 1
        np.add.at(change, start, 1)
        np.subtract.at(change, end, 1)
    gone = np.cumsum(change[:-1]) > 0
    removed, spans, digest, kept_text = [], [], [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        mask = gone[a:b]
        kept = data[a:b][~mask].tobytes()
        removed.append(int(mask.sum()))
        spans.append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
        digest.append(hashlib.sha256(kept).hexdigest())
        kept_text.append(kept)
    return pa.table(
        {
            "doc_id": docs["doc_id"].cast(pa.int64()),
            "n_bytes": pa.array(np.diff(offsets), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(spans, pa.int64()),
            "kept_sha256": pa.array(digest, pa.string()),
            "kept": pa.array(kept_text, pa.binary()),
        }
    )


def remove_repeats(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Every text without the bytes of 50-byte strings that a text of a smaller id has too.

    Returns ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs),
    ``kept_sha256`` and ``kept`` (the remaining bytes, which need not be valid UTF-8).

    A null text is empty.  A null id is greater than every other; rows of one id do not
    cover each other, and every row is returned.  Texts under 50 bytes are kept whole.
    Other columns are ignored.  ``part_bytes`` sizes the parts, not the results.
    """
    docs = pick(docs, doc_id="bigint", text="string")
    # Part numbers have 24 bits: beyond that many parts (134 TB) the parts grow instead.
    parts = min(parts_for(docs, "text", part_bytes), _NOWHERE)
    docs = docs.withColumn("part", part_of("doc_id", parts))
    by_part = docs.groupBy("part")
    keys = docs.select("part", "text").mapInArrow(_find_keys(parts), ROWS)
    marks = keys.groupBy("kind", "k").applyInArrow(_count_keys, ROWS)
    taken = by_part.cogroup(marks.withColumnRenamed("k", "part").groupBy("part")).applyInArrow(
        _take_stretches(parts), ROWS
    )
    covers = taken.groupBy("kind", "k").applyInArrow(_scan_bucket, ROWS)
    return by_part.cogroup(covers.withColumnRenamed("k", "part").groupBy("part")).applyInArrow(
        _digest,
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary",
    )
