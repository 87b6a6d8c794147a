"""WARC archives of pages, and capture histories merged from sorted runs of their records.

Archives are written with Spark's text writer, so they can lie in any store Spark reaches:
a row is a record (headers, blank line, payload) and the line separator is the two line
ends that close a record.  Records are read by their Content-Length, so payloads may hold
anything.

Every reading task sorts its records by URL key and time: a run.  A run is cut at bounds of
the key, and each range merges the runs' pieces with a loser tree.  Ranges follow the whole
sort key, so the captures of one URL spread over as many ranges as they need.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetables.config import work_folder
from pagetables.llm.common import pick, settled

#: Payloads below this size are never written as revisits.
REVISIT_BYTES = 100
#: Records in an archive at most.
RECORDS = 2000
#: Captures in a merged range, about.
RANGE_ROWS = 20_000
#: Keys that the bounds of the ranges are taken from, per range.
KEYS_PER_RANGE = 32
#: Pages carry no time of capture: the time of a record follows from its id, over a year.
FIRST_SECOND, SECONDS = 1_700_000_000, 31_536_000
_END = "\r\n"


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_END))


def records_of(pages: DataFrame) -> DataFrame:
    """The pages with payload, digest and what their record is to be."""
    pages = pick(pages, page_id="bigint", url="string", html="string").withColumn(
        "payload", F.coalesce("html", F.lit(""))
    )
    known = settled(
        pages.select("page_id", F.octet_length("payload").alias("n"), F.sha2(F.col("payload").cast("binary"), 256).alias("digest")),
        "digests",
    )
    first = (
        known.where(F.col("n") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"))
        .where("first_id < last_id")
        .select("digest", "first_id")
    )
    again = (
        known.where("page_id is not null")
        .join(first, "digest")
        .where("page_id > first_id")
        .select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "first_id")
        .distinct()
    )
    pages = pages.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    return pages.join(
        again, (F.col("page_id") == F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left"
    ).select("page_id", "url", "payload", "digest", F.col("first_id").alias("refers_to"))


def write_archives(pages: DataFrame, path: str, records: int = RECORDS) -> None:
    """One record per page, in gzipped archives below ``path``."""
    rows = records_of(pages)
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    moment = F.timestamp_seconds(F.lit(FIRST_SECOND) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(SECONDS)))
    safe_url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    record = F.concat(
        F.lit(f"WARC/1.0{_END}"),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        _header("WARC-Date", F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.when(F.col("url").isNull(), F.lit("")).otherwise(_header("WARC-Target-URI", safe_url)),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("WARC-Payload-Length", F.octet_length("payload")),
        F.when(revisit, _header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")))).otherwise(F.lit("")),
        _header("Content-Type", F.lit("text/html")),
        _header("Content-Length", F.octet_length(body)),
        F.lit(_END),
        body,
    )
    rows.select(record.alias("value")).write.option("lineSep", _END * 2).option("compression", "gzip").option(
        "maxRecordsPerFile", records
    ).text(path)


def parse_archive(raw: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and payload of each record."""
    at = 0
    while at < len(raw):
        cut = raw.index(b"\r\n\r\n", at)
        lines = raw[at:cut].decode().split(_END)
        if lines[0] != "WARC/1.0":
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        yield at, headers, raw[cut + 4 : cut + 4 + size]
        at = cut + 4 + size + 4


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then path and query: neighbours by site."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url or ""
    return ",".join(reversed(host.split("."))) + ")" + parts.path + ("?" + parts.query if parts.query else "")


def sort_key(key: str, when: str, page_id: int | None) -> str:
    return f"{key} {when} {-1 if page_id is None else page_id:020d}"


def captured_at(page_id: int | None) -> str:
    moment = datetime.fromtimestamp(FIRST_SECOND + (page_id or 0) % SECONDS, UTC)
    return moment.strftime("%Y-%m-%dT%H:%M:%SZ")


_COLUMNS = {
    "url_key": pa.string(),
    "captured_at": pa.string(),
    "page_id": pa.int64(),
    "url": pa.string(),
    "payload_bytes": pa.int64(),
    "payload_digest": pa.string(),
    "record_type": pa.string(),
    "refers_to": pa.int64(),
    "offset": pa.int64(),
    "sort_key": pa.string(),
}
_TYPES = "url_key string, captured_at string, page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, offset bigint, sort_key string"


def _id(text: str) -> int | None:
    inner = text.removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner else None


def _entry(offset: int, headers: dict[str, str], payload: bytes) -> tuple:
    digest, size = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["WARC-Payload-Length"])
    if headers["WARC-Type"] == "response":
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
    page, url = _id(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI")
    key, when = url_key(url), headers["WARC-Date"]
    order = sort_key(key, when, page)
    refers = _id(headers.get("WARC-Refers-To", ""))
    return key, when, page, url, size, digest, headers["WARC-Type"], refers, offset, order


class LoserTree:
    """k sorted runs in one order: inner nodes keep the loser of their match, the root's
    winner is next, and only the winner's path is played again."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs, self.at, self.k = runs, [0] * len(runs), max(1, len(runs))
        self.tree = [-1] * self.k
        for i in range(len(runs)):
            self._play(i)

    def _key(self, run: int) -> tuple:
        at = self.at[run]
        return (0, self.runs[run][at][-1], run) if at < len(self.runs[run]) else (1, "", run)

    def _play(self, run: int) -> None:
        node = (run + self.k) // 2
        while node:
            held = self.tree[node]
            if held < 0:
                self.tree[node] = run
                return
            if self._key(held) < self._key(run):
                self.tree[node], run = run, held
            node //= 2
        self.tree[0] = run

    def __iter__(self) -> Iterator[tuple]:
        if not self.runs:
            return
        while True:
            run = self.tree[0]
            if self.at[run] >= len(self.runs[run]):
                return
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            self._play(run)


def _bounds(keys: list[str], ranges: int) -> list[str]:
    keys = sorted(keys)
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def read_captures(spark: SparkSession, path: str, bounds: list[str]) -> DataFrame:
    """Every record of the archives in global order: ``range_no``, then ``place``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                raw = content.as_py()
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                entries = sorted((_entry(*r) for r in parse_archive(raw)), key=lambda e: e[-1])
                order = [e[-1] for e in entries]
                cuts = [0, *(bisect.bisect_left(order, b) for b in bounds), len(entries)]
                pieces = [(i, entries[a:b]) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
                blobs = [pa.table(dict(zip(_COLUMNS, map(pa.array, zip(*p, strict=True), _COLUMNS.values()), strict=True))) for _, p in pieces]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in pieces], pa.int32()), pa.array([_packed(t) for t in blobs], pa.binary())],
                    ["range_no", "run"],
                )

    def merge(group: pa.Table) -> pa.Table:
        unpacked = [pa.ipc.open_stream(raw).read_all() for raw in group["run"].to_pylist()]
        lists = [list(zip(*(c.to_pylist() for c in t.columns), strict=True)) for t in unpacked]
        merged = list(LoserTree(lists))
        out = dict(zip(_COLUMNS, map(pa.array, zip(*merged, strict=True), _COLUMNS.values()), strict=True))
        n = len(merged)
        return pa.table({"range_no": pa.array([group["range_no"][0].as_py()] * n, pa.int32()), "place": pa.array(range(n), pa.int32()), **out})

    ranged = files.mapInArrow(runs, "range_no int, run binary")
    return ranged.groupBy("range_no").applyInArrow(merge, f"range_no int, place int, {_TYPES}")


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def capture_histories(pages: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Writes the pages as archives, reads them back, and returns their captures in order.

    ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, and
    ``url_key``, ``captured_at``, ``url``, ``offset`` (in its archive), ``range_no``, ``place``.

    A null page is an empty payload.  Of equal payloads of ``REVISIT_BYTES`` or more the one
    with the smallest id is a response, the others revisit it; a page without an id is
    always a response.  Rows of one id and payload are all responses or all revisits.  A
    null URL has the empty key; line ends in a URL become spaces.  Other columns are ignored.
    """
    spark, path = pages.sparkSession, work_folder(pages.sparkSession, "archives")
    write_archives(pages, path)
    urls = pick(pages, page_id="bigint", url="string")
    ranges = max(1, -(-urls.count() // range_rows))
    # The bounds only balance the ranges: a bounded number of keys, by the least hash.
    picked = urls.orderBy(F.xxhash64("page_id", "url")).limit(ranges * KEYS_PER_RANGE).collect() if ranges > 1 else []
    keys = [sort_key(url_key(r["url"]), captured_at(r["page_id"]), r["page_id"]) for r in picked]
    bounds = _bounds(keys, ranges)
    return read_captures(spark, path, bounds).drop("sort_key")


def in_order(captures: DataFrame) -> DataFrame:
    """The captures with ``position``: the place of each among all of them, from 0.

    Ranges follow one another, so a range's places begin after the rows of those before it.
    The captures are read twice.  No rows give no rows.
    """
    ranges = captures.groupBy("range_no").agg(F.count("*").alias("rows"))
    # One row for each range of RANGE_ROWS pages.
    before = F.sum("rows").over(W.orderBy("range_no").rowsBetween(W.unboundedPreceding, -1))
    begin = ranges.select("range_no", F.coalesce(before, F.lit(0)).alias("_begin"))
    return captures.join(begin, "range_no").withColumn("position", F.col("_begin") + F.col("place")).drop("_begin")
