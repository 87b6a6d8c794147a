"""Benchmark decontamination by winnowing over words.

The least hash of ``GRAM``-word grams is kept in every window of ``WINDOW`` words, on both
sides, so every shared span of ``WINDOW`` words shares a kept gram.  Kept grams of texts
and items are joined; a hit carries the words around it, is compared word by word, and
extended to the whole shared run.  Items shorter than a window are kept whole, and texts
send their grams of those lengths.

A text sends only grams whose slot is set in a bit map of the items' grams.  The map has a
fixed size; it only saves sending, the join decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.llm.common import pick, settled, utf8

WINDOW = 10
GRAM = 5
#: Slots of the bit map (2 MB).
SLOTS = 1 << 24
#: Bytes of text taken at once, a longer text alone.
CHUNK = 1 << 20

_LETTER = np.zeros(256, np.uint64)
_KEEP = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
_LETTER[_KEEP] = np.random.default_rng(10).integers(1, 1 << 63, len(_KEEP), np.uint64) | np.uint64(1)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B]
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ORDER = np.random.default_rng(11).integers(1, 1 << 63, WINDOW, np.uint64) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out, size = np.ones(max(n, 1), np.uint64), 1
    while size < n:
        more = min(size, n - size)
        out[size : size + more] = out[:more] * np.uint64(pow(base, size, 1 << 64))
        size += more
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and its hash; a word does not cross an offset."""
    letter = _LETTER[data]
    inside = letter != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letter * _powers(_BASE, len(data)))))
    return start, end, _mixed((total[end] - total[start]) * _powers(_INVERSE, len(data))[start])


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total += words[i : i + len(total)] * _ORDER[i]
    return _mixed(total + np.uint64(n))


def kept_grams(words: np.ndarray, row_end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are least in some window of their row."""
    g, span = grams(words, GRAM), WINDOW - GRAM + 1
    if len(words) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(words) - WINDOW + 1
    least = np.lib.stride_tricks.sliding_window_view(g, span).min(axis=1)
    least[np.arange(n) + WINDOW > row_end[row[:n]]] = 0
    around = np.concatenate((np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)))
    most = np.lib.stride_tricks.sliding_window_view(around, span).max(axis=1)
    at = np.flatnonzero((most == g) & (most != 0))
    return at, g[at]


def _fingerprints(data: np.ndarray, offsets: np.ndarray, short: list[int], wanted) -> Iterator[tuple]:
    """For each row: its number of words, and (hash, words in gram, position, first word of
    the context, context) of its kept grams.

    ``short`` lists the gram lengths to keep everywhere; null in place of it keeps a row
    under a window whole.  ``wanted`` says which hashes are needed.
    """
    raw = data.tobytes().translate(_LOWER)
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
        base = offsets[a]
        local = offsets[a : b + 1] - base
        start, end, word = words_of(data[base : offsets[b]], local)
        bound = np.searchsorted(start, local)
        row = np.repeat(np.arange(b - a), np.diff(bound))
        row_end = bound[1:]
        at, key = kept_grams(word, row_end, row)
        found = [(at, key, np.full(len(at), GRAM), np.full(len(at), WINDOW - GRAM), np.full(len(at), WINDOW))]
        if short is None:
            count = np.diff(bound)
            for n in range(1, WINDOW):
                at = bound[:-1][count == n]
                if len(at):
                    found.append((at, grams(word, n)[at], np.full(len(at), -n), np.zeros(len(at), int), np.full(len(at), n)))
        else:
            for n in short:
                key = grams(word, n)
                at = np.flatnonzero(np.arange(len(key)) + n <= row_end[row[: len(key)]])
                found.append((at, key[at], np.full(len(at), -n), np.zeros(len(at), int), np.full(len(at), n)))
        at, key, kind, before, after = (np.concatenate(x) for x in zip(*found, strict=True))
        use = wanted(key)
        at, key, kind, before, after = at[use], key[use], kind[use], before[use], after[use]
        hits: dict[int, list] = {}
        for i in range(len(at)):
            r = int(row[at[i]])
            low = max(int(at[i] - before[i]), int(bound[r]))
            high = min(int(at[i] + after[i]), int(bound[r + 1]))
            context = b" ".join(raw[base + start[j] : base + end[j]] for j in range(low, high)).decode()
            hits.setdefault(r, []).append(
                (int(key[i : i + 1].view(np.int64)[0]), int(kind[i]), int(at[i] - bound[r]), int(low - bound[r]), context)
            )
        for r in range(b - a):
            yield int(bound[r + 1] - bound[r]), hits.get(r, [])
        a = b


_HIT = "struct<hash:bigint,kind:int,at:int,low:int,context:string>"
_HIT_TYPE = pa.list_(
    pa.struct(
        [("hash", pa.int64()), ("kind", pa.int32()), ("at", pa.int32()), ("low", pa.int32()), ("context", pa.string())]
    )
)
_FIELDS = ("hash", "kind", "at", "low", "context")


def _scan(docs: DataFrame, key: str, short: list[int] | None, slots) -> DataFrame:
    """(key, row hash, n_words, hits) of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if slots is None:
            wanted = lambda h: np.ones(len(h), bool)
        else:
            bits = slots.value
            wanted = lambda h: bits[(h % np.uint64(SLOTS)).astype(np.int64)]
        for batch in batches:
            data, offsets = utf8(batch["text"])
            n, hits = zip(*_fingerprints(data, offsets, short, wanted), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch[key],
                    batch["rid"],
                    pa.array(n, pa.int64()),
                    pa.array([[dict(zip(_FIELDS, h, strict=True)) for h in x] for x in hits], _HIT_TYPE),
                ],
                [key, "rid", "n_words", "hits"],
            )

    docs = docs.withColumn("rid", F.xxhash64("text"))
    return docs.mapInArrow(scan, f"{key} bigint, rid bigint, n_words bigint, hits array<{_HIT}>")


def _bit_map(items: DataFrame) -> np.ndarray:
    """One entry for each slot; at most ``SLOTS / 64`` rows reach the driver."""
    slot = F.pmod(F.col("slot"), F.lit(SLOTS))
    words = (
        items.select(F.conv(F.hex("hash"), 16, 10).cast("decimal(20,0)").alias("slot"))
        .select(slot.cast("int").alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("bits"))
    )
    out = np.zeros(SLOTS // 64, np.int64)
    for r in words.toLocalIterator():
        out[r["word"]] = r["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined hits compared word by word; the shared run if it holds a window or the whole item."""
    for batch in batches:
        out = []
        for doc, rid, kind, at, low, context, item_at, item_low, item_context, cid in zip(
            *(c.to_pylist() for c in batch.columns), strict=True
        ):
            mine, other = context.split(" "), item_context.split(" ")
            if kind < 0:
                if mine == other:
                    out.append((doc, rid, cid, at, at - kind))
                continue
            i, j = at - low, item_at - item_low
            if mine[i : i + GRAM] != other[j : j + GRAM]:
                continue
            left = right = 0
            while left < min(i, j) and mine[i - left - 1] == other[j - left - 1]:
                left += 1
            room = min(len(mine) - i, len(other) - j)
            while right < room and mine[i + right] == other[j + right]:
                right += 1
            if left + right >= WINDOW:
                out.append((doc, rid, cid, at - left, at + right))
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(cols, (pa.int64(),) * 3 + (pa.int32(),) * 2, strict=True)],
            ["doc_id", "rid", "cid", "first", "stop"],
        )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` and
    ``items`` (sorted as text) of every row of ``docs``.

    A word is hit if it lies in ``WINDOW`` consecutive words that an item has too, or in the
    whole of a shorter item.  Null and empty texts have no words; items without words have
    no window.  An item without an id causes hits but is not listed.  Repeated rows are
    returned as often as they come; an item that comes twice is listed once.  The rows of
    one id and text are judged together.  Other columns are ignored.
    """
    spark = docs.sparkSession
    items = _scan(pick(benchmark, item_id="bigint", text="string"), "item_id", None, None)
    items = settled(
        items.select("item_id", F.explode("hits").alias("h")).select(
            "item_id", *(F.col(f"h.{x}").alias(x) for x in _FIELDS)
        ),
        "benchmark",
    )
    contexts = items.select(
        "hash",
        "kind",
        F.col("at").alias("item_at"),
        F.col("low").alias("item_low"),
        F.col("context").alias("item_context"),
        F.xxhash64("kind", F.expr("at - low"), "context").alias("cid"),
        "item_id",
    )
    # A context is compared once, however many items have it.
    compared = contexts.groupBy("hash", "kind", "cid", "item_context").agg(
        F.first(F.struct("item_at", "item_low")).alias("p")
    )
    compared = compared.select("hash", "kind", "cid", "item_context", "p.item_at", "p.item_low")
    short = [-r["kind"] for r in items.where("kind < 0").select("kind").distinct().collect()]  # 9 at most
    slots = spark.sparkContext.broadcast(_bit_map(items))
    rows = settled(_scan(pick(docs, doc_id="bigint", text="string"), "doc_id", sorted(short), slots), "words")
    hits = rows.where(F.size("hits") > 0).select("doc_id", "rid", F.explode("hits").alias("h"))
    joined = hits.select("doc_id", "rid", *(F.col(f"h.{x}").alias(x) for x in _FIELDS)).join(
        compared, ["hash", "kind"]
    )
    spans = joined.select(
        "doc_id", "rid", "kind", "at", "low", "context", "item_at", "item_low", "item_context", "cid"
    ).mapInArrow(_extended, "doc_id bigint, rid bigint, cid bigint, first int, stop int")
    spans = settled(spans, "spans")
    key = ["doc_id", "rid"]
    covered = F.array_distinct(
        F.flatten(F.transform(F.collect_set(F.struct("first", "stop")), lambda x: F.sequence(x["first"], x["stop"] - 1)))
    )
    hit = spans.groupBy(*key).agg(F.size(covered).cast("bigint").alias("n_hit"))
    listed = (
        spans.select(*key, "cid")
        .distinct()
        .join(contexts.select("cid", "item_id").where("item_id is not null").distinct(), "cid")
        .groupBy(*key)
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    found = hit.join(listed.select(F.col("doc_id").alias("d"), F.col("rid").alias("r"), "items"),
                     F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("rid") == F.col("r")), "left")
    found = found.select(F.col("doc_id").alias("d"), F.col("rid").alias("r"), "n_hit", "items")
    every = rows.select("doc_id", "rid", "n_words").join(
        found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("rid") == F.col("r")), "left"
    )
    listed_items = F.coalesce("items", F.array().cast("array<string>"))
    return every.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.size(listed_items).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", listed_items), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        listed_items.alias("items"),
        "rid",
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, that share no window with an item."""
    bad = contamination(docs, benchmark).where("contaminated").select(
        F.col("doc_id").alias("bad_id"), F.col("rid").alias("bad_rid")
    )
    same = docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_rid"])
    return docs.join(bad, same, "left_anti")
