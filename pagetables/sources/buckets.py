"""Tables in a folder whose files are bucketed by place: the key and a salt.

A row's bucket is the hash of its place, and a file holds rows of one bucket.  So a join on
places moves only its narrow side, and wide columns stay where they were written; a
key with very many rows is spread over as many buckets as there are salts.  The layout is
declared to the session's catalog under a name made from the path; the catalog
holds no data, any session can declare the same folder again.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

#: Buckets of a new table; a table keeps the number it was made with.
BUCKETS = 32
#: Buckets that the rows of one key are spread over.
SALTS = 8
#: Files that a task may write at once; beyond, rows are sorted by bucket.
OPEN_FILES = 4096
_LAYOUT = "_layout"


def place(key: str, *salt: str) -> Column:
    """Where a row goes: its key and a salt from some of its columns."""
    return F.concat(key, F.lit("#"), F.pmod(F.xxhash64(*salt), F.lit(SALTS)).cast("string"))


def places(key: Column) -> Column:
    """All places where rows of a key may be."""
    return F.transform(F.array(*map(F.lit, range(SALTS))), lambda salt: F.concat(key, F.lit("#"), salt.cast("string")))


def attach(narrow: DataFrame, wide: DataFrame, condition: Column | None = None) -> DataFrame:
    """Rows of the ``wide`` table at the places ``narrow._place``.

    The narrow side is moved to the buckets and hashed, the wide one streamed.
    """
    on = narrow["_place"] == wide["place"]
    return wide.join(narrow.hint("shuffle_hash"), on if condition is None else on & condition)


def bucket_count(spark: SparkSession, path: str, buckets: int | None = None) -> int:
    """The number of buckets of the table at ``path``; a new table gets ``buckets``."""
    schema = "buckets int"
    try:
        stored = spark.read.schema(schema).json(f"{path}/{_LAYOUT}").agg(F.max("buckets")).first()[0]
    except AnalysisException:  # no such folder: the table is new
        stored = None
    if stored:
        return stored
    count = buckets or BUCKETS
    spark.createDataFrame([(count,)], schema).coalesce(1).write.mode("ignore").json(f"{path}/{_LAYOUT}")
    return count


def declared(
    spark: SparkSession, path: str, schema: T.StructType, partitions: T.StructType, buckets: int | None = None
) -> str:
    """Name of the table in ``path``, with its present partitions."""
    count = bucket_count(spark, path, buckets)
    name = "pagetables_" + hashlib.sha256(path.encode()).hexdigest()[:24]
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in [*schema, *partitions])
    by = ", ".join(f"`{field.name}`" for field in partitions)
    location = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY ({by}) "
        f"CLUSTERED BY (place) INTO {count} BUCKETS LOCATION '{location}'"
    )
    spark.sql(f"MSCK REPAIR TABLE {name} SYNC PARTITIONS")
    spark.sql(f"REFRESH TABLE {name}")
    return name


def insert_statement(name: str, view: str, partition: dict[str, str | int]) -> str:
    values = ", ".join(
        f"{column} = {value}" if isinstance(value, int) else f"{column} = '{value}'" for column, value in partition.items()
    )
    return f"INSERT OVERWRITE {name} PARTITION ({values}) SELECT * FROM {view}"


def write_partition(rows: DataFrame, name: str, **partition: str | int) -> None:
    """Replace one partition by ``rows``, whose columns are those of the table.

    A task writes to all its buckets at once, so rows are neither shuffled nor sorted.
    """
    spark = rows.sparkSession
    view = f"{name}_rows_{hashlib.sha256(repr(partition).encode()).hexdigest()[:16]}"
    rows.createOrReplaceTempView(view)
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(OPEN_FILES))
    try:
        spark.sql(insert_statement(name, view, partition))
    finally:
        spark.conf.set(setting, before)
        spark.catalog.dropTempView(view)
