"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations.

Targets come from the weights, with every source held to ``REPEATS`` times its size.  The
targets are apportioned in blocks of ``BLOCK`` words by highest quotients t / (2 k + 1), and
the blocks of a source over its shards likewise, by their sizes.  A shard puts its documents
in seeded order, which makes a row of blocks, and takes its blocks from the front, round
after round.

A shard holds about ``SHARD`` words and so a bounded number of documents, whatever the size
of its source; only rows of sources and of shards are ever put in one order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetables.llm.common import WORD, pick, settled

REPEATS = 3
BLOCK = 64
SHARD = 2_000_000
SEED = 9
#: Weights of the sources in order, repeating.
WEIGHTS = (1.0, 2.0, 3.0)


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares by weight, none above ``repeats`` times
    its size, the excess shared by weight among the others.

    Sources run by code point, null last.  In order of size / weight the sources that reach
    their limit come first; the others share what is left, so one pass settles all.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    values = F.array(*map(F.lit, weights))
    weighed = sources.withColumn(
        "weight", F.element_at(values, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    )
    limit = F.lit(repeats) * F.col("source_size")
    by_limit = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = by_limit.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    weight_left = F.sum("weight").over(by_limit.rowsBetween(W.currentRow, W.unboundedFollowing))
    reached = weighed.withColumn("left", left.cast("double")).withColumn("weight_left", weight_left)
    share = F.col("left") / F.col("weight_left")
    reached = reached.withColumn("level", F.when(share * F.col("weight") < limit, share))
    # The first source below its limit sets the level for all that follow.
    level = F.min(F.struct(F.col("level").isNull().alias("none"), F.col("place"), F.col("level"))).over(every)["level"]
    reached = reached.withColumn("place", F.row_number().over(by_limit)).withColumn("level", level)
    target = F.least(limit.cast("double"), F.coalesce(F.col("level") * F.col("weight"), limit.cast("double")))
    return reached.select("source", "source_size", "weight", target.alias("target"))


def apportion(rows: DataFrame, group: list[str], name: list[str], value: str, seats: Column, out: str) -> DataFrame:
    """Sainte-Laguë: ``seats`` of each group given to its rows by highest quotients of ``value``.

    Rounding value * seats / total is the result of the quotients for one divisor.  If it
    gives e seats too few or too many, the next e quotients of each row decide, so only
    those are listed.  Ties go by ``name``.
    """
    in_group = W.partitionBy(*group)
    total = F.sum(value).over(in_group)
    fair = F.when(total > 0, F.col(value) * F.col("_seats") / total).otherwise(F.lit(0.0))
    rows = rows.withColumn("_seats", seats.cast("bigint"))
    rows = rows.withColumn("_base", F.floor(fair + F.lit(0.5)).cast("bigint"))
    rows = rows.withColumn(
        "_open", F.when(total > 0, F.col("_seats") - F.sum("_base").over(in_group)).otherwise(F.lit(0))
    )
    first = F.when(F.col("_open") > 0, F.col("_base")).otherwise(
        F.greatest(F.lit(0).cast("bigint"), F.col("_base") + F.col("_open"))
    )
    last = F.when(F.col("_open") > 0, F.col("_base") + F.col("_open") - 1).otherwise(F.col("_base") - 1)
    listed = rows.where((F.col("_open") != 0) & (F.col(value) > 0) & (last >= first)).select(
        *group, *name, "_open", F.col(value).alias("_value"), F.explode(F.sequence(first, last)).alias("_k")
    )
    quotient = F.col("_value") / (2 * F.col("_k") + 1)
    ranked = listed.withColumn("_signed", F.when(F.col("_open") > 0, -quotient).otherwise(quotient)).withColumn(
        "_rank",
        F.row_number().over(in_group.orderBy("_signed", *(F.col(n).asc_nulls_last() for n in name))),
    )
    change = (
        ranked.where(F.col("_rank") <= F.abs("_open"))
        .groupBy(*group, *name)
        .agg(F.sum(F.signum("_open")).cast("bigint").alias("_change"))
    )
    keys = [*group, *name]
    change = change.select(*(F.col(k).alias(f"_{k}") for k in keys), "_change")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = rows.join(change, same, "left")
    return joined.select(
        *(c for c in rows.columns if not c.startswith("_")),
        (F.col("_base") + F.coalesce("_change", F.lit(0))).alias(out),
    )


def mixed(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    repeats: int = REPEATS,
    block: int = BLOCK,
    shard: int = SHARD,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken``, ``source`` and ``shard`` of every row.

    ``size`` is the number of words, ``taken`` how many of them the mix takes, repeats
    counted: at most ``repeats`` times the size.  A null source is a source of its own, the
    last; null and empty texts have size 0 and give nothing.  The order in a shard follows a
    hash of seed and id; rows of one id and size are interchangeable.  An empty table gives
    no rows.  Other columns are ignored.
    """
    rows = pick(docs, doc_id="bigint", source="string", text="string")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = settled(rows.select("doc_id", "source", words.alias("size"), F.xxhash64("text").alias("rid")), "sizes")
    sources = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats)
    everything = F.sum("target").over(W.partitionBy("all"))
    sources = apportion(
        sources.withColumn("all", F.lit(1)),
        ["all"],
        ["source"],
        "target",
        F.round(everything / block),
        "blocks",
    )
    sources = settled(
        sources.select(
            F.col("source").alias("_source"),
            "source_size",
            "target",
            "blocks",
            F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard)).cast("bigint").alias("shards"),
        ),
        "sources",
    )
    placed = rows.join(sources, F.col("source").eqNullSafe(F.col("_source")))
    placed = placed.withColumn("order", F.xxhash64(F.lit(seed), "doc_id")).withColumn(
        "shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.col("shards"))
    )
    shards = placed.groupBy("source", "shard").agg(
        F.sum("size").alias("shard_size"), F.first("blocks").alias("source_blocks")
    )
    quotas = apportion(shards, ["source"], ["shard"], "shard_size", F.col("source_blocks"), "quota")
    quotas = settled(
        quotas.select(
            F.col("source").alias("_source2"),
            F.col("shard").alias("_shard"),
            "shard_size",
            F.least(F.col("quota") * block, F.col("shard_size") * repeats).alias("words"),
        ),
        "quotas",
    )
    before = F.coalesce(
        F.sum("size").over(
            W.partitionBy("source", "shard").orderBy("order", "doc_id", "size", "rid").rowsBetween(W.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    ordered = placed.withColumn("before", before).join(
        quotas, F.col("source").eqNullSafe(F.col("_source2")) & (F.col("shard") == F.col("_shard"))
    )
    some = F.col("shard_size") > 0
    rounds = F.when(some, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0)
    rest = F.col("words") - rounds * F.col("shard_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("before")))
    return ordered.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (rounds * F.col("size") + part).cast("bigint").alias("taken"),
        "source",
        "shard",
        "rid",
    )


def take_mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all columns and ``size``, ``target`` and ``taken``.

    Rows of one id and text are one document here: it comes once, with what all of them take.
    Columns of ``docs`` with the names of the three are replaced.
    """
    mix = mixed(docs, **how).groupBy("doc_id", "rid").agg(
        F.sum("size").alias("size"), F.first("target").alias("target"), F.sum("taken").alias("taken")
    )
    rest = docs.drop("size", "target", "taken")
    key, text = ("_" * (1 + max(map(len, rest.columns))) + name for name in ("id", "text"))
    mix = mix.where("taken > 0").withColumnsRenamed({"doc_id": key, "rid": f"{text}2"})
    keyed = rest.withColumn(text, F.xxhash64(rest["text"])).dropDuplicates(["doc_id", text])
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(text) == F.col(f"{text}2"))
    return keyed.join(mix, same).drop(key, text, f"{text}2")
