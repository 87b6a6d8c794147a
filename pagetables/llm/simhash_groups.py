"""Near copies by SimHash: exact comparison of tiles of fingerprints.

Equal fingerprints become one.  Fingerprints are dealt to tiles by the population counts
of their halves.  Two tiles are compared only if their counts come within the radius, since
a differing bit changes a count by one.  Inside a pair of tiles the same bound on the
counts of the four 16-bit words leaves out most blocks; the rest is compared with exclusive
or and bit counts.  A pair of tiles reports a spanning forest of its links, so that a group
of n near copies gives up to n rows and never n * n.

The number of tiles is fixed, so a fingerprint (eight bytes) is sent a bounded number of
times; comparisons still grow with the square of the number of different fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.llm.common import pick, runs, settled, utf8
from pagetables.llm.components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Tiles at most, apart from those that a cell's rest or a small cell adds.
TILES = 40
#: Fingerprints in a tile at least.
TILE_ROWS = 8192
#: Comparisons at once.
BLOCK = 1 << 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_HALF = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hash of every shingle of a UTF-8 text, of all words if there are fewer."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.cumsum(size) - size
    k = min(shingle, len(words))
    end = (start + size - 1)[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(start.tolist(), end, strict=False)], "<u8")


def _majority(hashes: np.ndarray) -> bytes:
    """The bits that over half of the hashes have set, in eight bytes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes()


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text: a bit is set if over half of the shingles' hashes have it."""
    return int.from_bytes(_majority(shingle_hashes(text, shingle)), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed 64-bit number, of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch["text"])
            raw, at = data.tobytes(), at.tolist()
            fps = [fingerprint(raw[a:b], shingle) for a, b in zip(at[:-1], at[1:], strict=True)]
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], fp], ["doc_id", "fp"])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(hashed, "doc_id bigint, fp bigint")


def _cell(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp >> _HALF).astype(np.int64) * 33 + np.bitwise_count(fp & _LOW)


class Tiling:
    """Tiles over the cells (population counts of both halves) and the pairs to compare."""

    def __init__(self, counts: dict[int, int], radius: int, tiles: int = TILES, rows: int = TILE_ROWS) -> None:
        most = max(rows, -(-sum(counts.values()) // tiles))
        self.first, self.pieces = np.zeros(33 * 33, np.int64), np.ones(33 * 33, np.int64)
        boxes: list[list[int]] = []
        held = most
        for cell in sorted(counts, key=lambda c: (c // 33 + c % 33, c)):
            n = counts[cell]
            if n > most or held + n > most:
                self.pieces[cell] = max(1, -(-n // most))
                self.first[cell] = len(boxes)
                boxes += [[cell] for _ in range(self.pieces[cell])]
                held = n if self.pieces[cell] == 1 else most
            else:
                self.first[cell] = len(boxes) - 1
                boxes[-1].append(cell)
                held += n
        self.pairs: list[list[tuple[int, int]]] = [[] for _ in boxes]
        n = 0
        for i, a in enumerate(boxes):
            for j in range(i, len(boxes)):
                b = boxes[j]
                high = np.abs(np.subtract.outer(np.array(a) // 33, np.array(b) // 33))
                low = np.abs(np.subtract.outer(np.array(a) % 33, np.array(b) % 33))
                if (high + low).min() <= radius:
                    self.pairs[i].append((n, 0))
                    if j > i:
                        self.pairs[j].append((n, 1))
                    n += 1

    def tile(self, fp: np.ndarray) -> np.ndarray:
        cell = _cell(fp)
        salt = ((fp * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)
        return self.first[cell] + salt % self.pieces[cell]


def _by_words(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the population counts of the 16-bit words, where each block begins, its counts."""
    counts = np.bitwise_count(np.ascontiguousarray(fp).view("<u2").reshape(-1, 4)).astype(np.int16)
    key = counts @ np.array([1, 17, 289, 4913])
    order = np.argsort(key, kind="stable")
    at = runs(key[order])
    return order, at, counts[order[at[:-1]]]


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives the ends of the links the least label of what they now belong to."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def linked(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all links between two tiles, or inside one (right is None)."""
    nodes = left if right is None else np.concatenate((left, right))
    label = np.arange(len(nodes))
    order, at, counts = _by_words(left)
    other = left if right is None else right
    shift = 0 if right is None else len(left)
    order_r, at_r, counts_r = (order, at, counts) if right is None else _by_words(right)
    sorted_r, size_r = other[order_r], np.diff(at_r)
    for i in range(len(counts)):
        near = np.flatnonzero(np.abs(counts_r - counts[i]).sum(axis=1) <= radius)
        if right is None:
            near = near[near >= i]
        n = size_r[near]
        if not n.sum():
            continue
        where = np.repeat(at_r[near] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        block, mine = sorted_r[where], order[at[i] : at[i + 1]]
        step = max(1, BLOCK // len(block))
        for a in range(0, len(mine), step):
            rows = mine[a : a + step]
            close = np.bitwise_count(left[rows][:, None] ^ block[None, :]) <= radius
            x, y = np.nonzero(close)
            _unite(label, rows[x], order_r[where[y]] + shift)
    hung = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[hung], nodes[label[hung]]


def _links(nodes: DataFrame, radius: int, tiles: int, tile_rows: int) -> DataFrame:
    """Links (a, b) that connect whatever lies within the radius, over different fingerprints."""
    cell = F.bit_count(F.shiftrightunsigned("fp", 32)) * 33 + F.bit_count(F.col("fp").bitwiseAND(0xFFFFFFFF))
    # At most 33 * 33 rows.
    counts = {r["cell"]: r["n"] for r in nodes.groupBy(cell.alias("cell")).agg(F.count("fp").alias("n")).collect()}
    tiling = Tiling(counts, radius, tiles, tile_rows)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            tile = tiling.tile(fp)
            order = np.argsort(tile, kind="stable")
            at, out = runs(tile[order]), []
            for a, b in zip(at[:-1], at[1:], strict=True):
                blob = fp[order[a:b]].tobytes()
                out += [(pair, side, blob) for pair, side in tiling.pairs[tile[order[a]]]]
            pair, side, blob = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair, pa.int32()), pa.array(side, pa.int32()), pa.array(blob, pa.binary())],
                ["pair", "side", "blob"],
            )

    def compare(group: pa.Table) -> pa.Table:
        sides: list[list[bytes]] = [[], []]
        for side, blob in zip(group["side"].to_pylist(), group["blob"].to_pylist(), strict=True):
            sides[side].append(blob)
        left, right = (np.frombuffer(b"".join(x), np.uint64) for x in sides)
        empty = np.zeros(0, np.uint64)
        # A pair has a second side unless it is a tile with itself or the second is empty.
        own = int(group["pair"][0].as_py()) in alone
        if own:
            a, b = linked(left, None, radius)
        else:
            a, b = linked(left, right, radius) if len(left) and len(right) else (empty, empty)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    sided = {pair for each in tiling.pairs for pair, side in each if side}
    alone = {pair for each in tiling.pairs for pair, _ in each} - sided
    return nodes.mapInArrow(deal, "pair int, side int, blob binary").groupBy("pair").applyInArrow(
        compare, "a bigint, b bigint"
    )


def near_groups(
    docs: DataFrame,
    radius: int = RADIUS,
    shingle: int = SHINGLE,
    tiles: int = TILES,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` of every row.

    ``component_id`` is the smallest id among all rows reachable over fingerprints that
    differ in ``radius`` bits at most.  Null and empty texts, and texts of white space, have
    fingerprint zero and link like any other.  Rows without an id get a fingerprint and the
    component of their group; where no row of it has an id, that is null.  Repeated rows
    are returned as often as they come.  Other columns are ignored.
    """
    rows = settled(fingerprints(docs, shingle), "fingerprints")
    nodes = settled(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "fingerprints")
    roots = components(_links(nodes.select("fp"), radius, tiles, tile_rows))
    grouped = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    least = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = grouped.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group (see `near_groups`), and
    rows without an id.  Only the ids of the rows that go are joined."""
    groups = near_groups(docs, radius, shingle)
    dropped = groups.where("doc_id > component_id").select(F.col("doc_id").alias("_dropped_id")).distinct()
    return docs.join(dropped, docs["doc_id"] == F.col("_dropped_id"), "left_anti")
