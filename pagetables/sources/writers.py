"""Writers of the resource table and of the store of responses.

The resource table is a log of batches, a partition per writer and batch.  A batch is written
whole and a repeated batch replaces its own partition, so retries change nothing and no writer
touches what another wrote.  Rows carry the time of writing, which orders the writes of
different writers.  Writing neither sorts nor shuffles nor rewrites anything: which row of a
key is current is decided on reading, by narrow columns; `compact_resources` folds the log
into a new table, bucket by bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.urls import resource_key
from ..operators.store import export_resource_json, latest_resources, markdown_is_blank
from .buckets import declared, place, write_partition
from .readers import read_resources


def _field(rows: DataFrame, name: str, kind) -> Column:
    return (F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name)


def _sequence(records: DataFrame) -> Column:
    """Order of the writes of one time, as a number."""
    if "seq" not in records.columns:
        return F.lit(None).cast("bigint")
    is_time = dict(records.dtypes)["seq"].startswith("timestamp")
    return F.unix_micros(F.col("seq").cast("timestamp")) if is_time else F.col("seq").cast("bigint")


def write_resources(
    records: DataFrame, path: str, batch_id: int, writer: str = "direct", buckets: int | None = None
) -> None:
    """Write one batch of a writer.  Of rows with one key the last by time and ``seq`` counts.

    A writer numbers its own batches; two that share a name replace each other's.
    ``buckets`` is the number for a new table: about one for every GB of Markdown.
    """
    spark = records.sparkSession
    fields = records.select(
        *[_field(records, field.name, field.dataType) for field in schemas.RESOURCES],
        _sequence(records).alias("seq"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = fields.withColumns(
        {
            "markdown_blank": markdown_is_blank(F.col("markdown")),
            "markdown_length": F.length("markdown").cast("bigint"),
            "written_at": F.current_timestamp(),
            "place": place("key", "row"),
        }
    ).select(*schemas.RESOURCE_LOG.fieldNames())
    name = declared(spark, path, schemas.RESOURCE_LOG, schemas.BATCHES, buckets)
    write_partition(rows, name, writer=writer, batch_id=batch_id)


def compact_resources(spark: SparkSession, path: str, new_path: str, buckets: int | None = None) -> None:
    """Write the current records of ``path`` as the first batch of ``new_path``.

    A task folds one bucket and writes its rows to the buckets of the new table.
    """
    write_resources(read_resources(spark, path), new_path, 0, "compact", buckets)


def merge_resources(records: DataFrame, table: str) -> None:
    """Last write per key into a table of a catalog that supports ``MERGE``.

    Spark's own file tables do not; this is for catalogs of table formats that do.
    """
    last = latest_resources(records).select(*schemas.RESOURCES.fieldNames()).alias("new")
    merge = last.mergeInto(table, F.col(f"{table}.key") == F.col("new.key"))
    merge.whenMatched().updateAll().whenNotMatched().insertAll().merge()


def write_responses(
    responses: DataFrame, path: str, batch_id: int, writer: str = "direct", buckets: int | None = None
) -> None:
    """Write one batch of landed responses by resource key; a URL that is not valid keeps its text."""
    fields = responses.select(*[_field(responses, field.name, field.dataType) for field in schemas.RESPONSES])
    key = F.coalesce(resource_key("url"), F.concat(F.lit("#"), "url"))
    rows = fields.withColumns({"key": key, "row": F.monotonically_increasing_id()}).withColumn("place", place("key", "row"))
    name = declared(responses.sparkSession, path, schemas.RESPONSE_STORE, schemas.BATCHES, buckets)
    write_partition(rows.select(*schemas.RESPONSE_STORE.fieldNames()), name, writer=writer, batch_id=batch_id)


def write_resource_json(records: DataFrame, path: str) -> None:
    """One JSON text per record, in a folder per status."""
    export_resource_json(records).select("status", "value").write.mode("overwrite").partitionBy(
        "status"
    ).text(path)
