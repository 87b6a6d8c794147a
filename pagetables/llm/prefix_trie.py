"""The trie of conversation prefixes by van Emde Boas recursion.

A node is a prefix of turns; its name is the least conversation that begins with it.  The
sequences are cut at half their depth, the halves again, down to single turns.  Depth d is
the cut of one block, that of the lowest set bit of d: it begins at depth d - bit, which an
earlier level named, and its upper half is one block of ``bit`` turns whose digest is a tree
hash.  So a level names the cuts of all its blocks at once, upper tries and lower forests in
parallel, by grouping (depth, name at the beginning, digest of the block).  There are as many
levels as the longest conversation has bits.  Conversations alone in a node are alone below.

Totals go the other way: those of a lower half are grafted on every turn of the upper half,
block by block up to the whole conversation, and those of conversations on their nodes.

A conversation's turns are numbered across range partitions, so a long one is never in one
task.  Turns with the same number are ordered by role and text digest (SHA-256 of both);
rows without conv_id belong to no conversation and are left out; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetables.llm.common import WORD, pick, settled

#: Bases are the conversations whose id is a multiple of this; turns taken from them are under ``HEADS``.
EVERY, HEADS = 20, 4
#: Characters of the decimal ids of one piece that is hashed.
PIECE = 1 << 16


def turns_of(conversations: DataFrame) -> DataFrame:
    """(c, pos, sym, words): the turns of each conversation numbered from 1."""
    role, text = (F.coalesce(name, F.lit("")) for name in ("role", "text"))
    rows = pick(conversations, conv_id="bigint", turn="bigint", role="string", text="string").where("conv_id IS NOT NULL")
    narrow = rows.select(
        F.col("conv_id").alias("c"),
        "turn",
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("sym"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("sym")]
    ranged = settled(narrow.repartitionByRange("c", *order).withColumn("pid", F.spark_partition_id()), "turns")
    parts = ranged.groupBy("c", "pid").agg(F.count("c").alias("n"))
    before = Window.partitionBy("c").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("c", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("c", "pid").orderBy(*order))
    numbered = ranged.withColumn("inside", inside).join(offsets, ["c", "pid"])
    return numbered.select("c", (F.col("offset") + F.col("inside")).alias("pos"), "sym", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (c, d, sym, words), and their lengths (c, length).

    The first h turns come from the conversation c - c % 20, h = crc32 of c modulo 4.
    """
    own = turns.groupBy("c").agg(F.max("pos").alias("own"))
    head = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(HEADS))
    base = F.col("c") - F.col("c") % EVERY
    plan = own.select("c", "own", head.alias("h"), base.alias("base")).join(
        own.select(F.col("c").alias("base"), F.col("own").alias("of_base")), "base", "left"
    )
    plan = settled(
        plan.select("c", "base", "h", "own", F.least("h", F.coalesce("of_base", F.lit(0))).cast("bigint").alias("head")),
        "conversations",
    )
    heads = turns.where(F.col("pos") < HEADS).withColumnRenamed("c", "base")
    taken = plan.join(heads, "base").where("pos <= head").select("c", F.col("pos").alias("d"), "sym", "words")
    rest = turns.join(plan.select("c", "h", "head"), "c").where("pos > h")
    kept = rest.select("c", (F.col("pos") - F.col("h") + F.col("head")).alias("d"), "sym", "words")
    lengths = plan.select("c", (F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    return taken.unionByName(kept), lengths


def _bit(depth: str) -> Column:
    """The lowest set bit of a depth."""
    return F.col(depth).bitwiseAND(-F.col(depth))


def block_digests(turns: DataFrame, levels: int) -> DataFrame:
    """(c, d, digest): the tree hash of the ``bit`` turns up to depth d, for every turn."""
    layer = turns.select("c", F.col("d").alias("i"), F.col("sym").alias("digest"))
    found = None
    for level in range(levels + 1):
        odd = layer.where("i % 2 = 1").select("c", (F.col("i") * (1 << level)).alias("d"), "digest")
        found = odd if found is None else found.unionByName(odd)
        if level < levels:
            left, right = (F.max(F.when(F.col("i") % 2 == side, F.col("digest"))) for side in (1, 0))
            pairs = layer.groupBy("c", F.floor((F.col("i") + 1) / 2).cast("bigint").alias("i")).agg(
                left.alias("left"), right.alias("right")
            )
            joined = F.unhex(F.sha2(F.concat("left", "right"), 256))
            layer = settled(pairs.where("right IS NOT NULL").select("c", "i", joined.alias("digest")), "blocks")
    return found


def named(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(c, d, name, n): the node of every prefix of every conversation, the root included.

    The cut of a block is named by the least member; a node with one member needs no search.
    """
    whole = lengths.agg(F.min("c").alias("name"), F.count("c").alias("n"), F.max("length").alias("longest")).first()
    roots = lengths.select(
        "c", F.lit(0).cast("bigint").alias("d"), F.lit(whole["name"]).cast("bigint").alias("name"), F.lit(whole["n"]).cast("bigint").alias("n")
    )
    levels = max(0, (whole["longest"] or 0).bit_length() - 1)
    blocks = settled(block_digests(turns, levels).withColumn("bit", _bit("d")), "digests")
    names = settled(roots, "names")
    for level in range(levels, -1, -1):
        cuts = blocks.where(F.col("bit") == 1 << level).withColumn("lo", F.col("d") - F.col("bit"))
        begun = cuts.join(names.select("c", F.col("d").alias("lo"), F.col("name").alias("top"), "n"), ["c", "lo"])
        begun = settled(begun.select("c", "d", "digest", "top", "n"), "cuts")
        shared = begun.where("n > 1").drop("n")
        groups = settled(
            shared.groupBy("d", "top", "digest").agg(F.min("c").alias("name"), F.count("c").alias("n")), "groups"
        )
        found = shared.join(groups, ["d", "top", "digest"]).select("c", "d", "name", "n")
        alone = begun.where("n = 1").select("c", "d", F.col("c").alias("name"), "n")
        names = names.unionByName(settled(found.unionByName(alone), "names"))
    return names


def suffix_sums(own: DataFrame, levels: int) -> DataFrame:
    """(c, d, total): the sum of ``own`` over a conversation from depth d on.

    Level by level, the total of a block's lower half is grafted on its upper half.
    """
    sums = own.select("c", "d", F.col("own").alias("total"))
    layer = own.select("c", F.col("d").alias("block"), F.col("own").alias("total"))
    for level in range(levels):
        lower = layer.where("block % 2 = 1").select("c", (F.col("block") - 1).alias("block"), F.col("total").alias("grafted"))
        sums = sums.withColumn("block", F.shiftright("d", level)).join(lower, ["c", "block"], "left")
        sums = sums.select("c", "d", (F.col("total") + F.coalesce("grafted", F.lit(0))).alias("total"))
        layer = layer.groupBy("c", F.shiftright("block", 1).alias("block")).agg(F.sum("total").alias("total"))
    return sums


def id_digests(ends: DataFrame) -> DataFrame:
    """(d, name, ends_sha256) of the decimal ids ``c`` of each (d, name), in order.

    Ids are range partitioned and written in pieces, so a node with very many ids is spread
    over tasks; only its pieces of text go through one hash, as a stream.
    """

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, ids, size = None, None, [], 0

        def out() -> pa.RecordBatch:
            columns = [pa.array([at[0]]), pa.array([at[1]]), pa.array([first]), pa.array([",".join(ids)])]
            return pa.RecordBatch.from_arrays(columns, ["d", "name", "first", "ids"])

        for batch in batches:
            for d, name, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if at != (d, name) or size > PIECE:
                    if ids:
                        yield out()
                    at, first, ids, size = (d, name), c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            yield out()

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, running = None, None

        def out() -> pa.RecordBatch:
            columns = [pa.array([at[0]]), pa.array([at[1]]), pa.array([running.hexdigest()])]
            return pa.RecordBatch.from_arrays(columns, ["d", "name", "ends_sha256"])

        for batch in batches:
            for d, name, _, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if at == (d, name):
                    running.update(b"," + ids.encode())
                    continue
                if at is not None:
                    yield out()
                at, running = (d, name), hashlib.sha256(ids.encode())
        if at is not None:
            yield out()

    ranged = ends.select("d", "name", "c").repartitionByRange("d", "name", "c").sortWithinPartitions("d", "name", "c")
    written = ranged.mapInArrow(pieces, "d bigint, name bigint, first bigint, ids string")
    together = written.repartition("d", "name").sortWithinPartitions("d", "name", "first")
    return together.mapInArrow(hashed, "d bigint, name bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for every node of the trie over the rebuilt conversations.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).
    """
    turns, lengths = rebuilt(settled(turns_of(conversations), "numbered"))
    turns, lengths = settled(turns, "rebuilt"), settled(lengths, "lengths")
    members = settled(named(turns, lengths), "members")

    # one row for each node: that of the conversation it is named after
    tops = members.where("c = name").select("c", "d", "n")
    above = members.select("c", (F.col("d") + 1).alias("d"), F.col("name").alias("parent"))
    words = turns.select("c", "d", "words").join(tops, ["c", "d"], "right").join(above, ["c", "d"], "left")
    nodes = settled(
        words.select("c", "d", "n", "parent", ((F.col("n") - 1) * F.coalesce("words", F.lit(0))).alias("own")), "nodes"
    )
    children = nodes.where("parent IS NOT NULL").groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("c")).agg(
        F.count("d").alias("n_children")
    )
    nodes = settled(nodes.join(children, ["c", "d"], "left").fillna(0, ["n_children"]), "nodes-children")

    # nodes with one member are chains: one leaf, nothing saved; the others get totals of their members
    deepest = nodes.agg(F.max(F.when(F.col("n") > 1, F.col("d")))).first()[0] or 0
    leaf = nodes.where("n_children = 0").select("c", F.lit(1).cast("bigint").alias("leaf"))
    shared = settled(members.where("n > 1"), "shared")
    totals = suffix_sums(
        shared.join(nodes.select("c", "d", "own"), ["c", "d"], "left").select("c", "d", F.coalesce("own", F.lit(0)).alias("own")),
        deepest.bit_length(),
    )
    summed = (
        shared.join(totals, ["c", "d"])
        .join(leaf, "c", "left")
        .groupBy("d", F.col("name").alias("c"))
        .agg(F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum("total").alias("saved_tokens"))
    )
    ends = shared.join(lengths, "c").where("d = length")
    digests = id_digests(ends).withColumnRenamed("name", "c")
    alone = F.when(F.col("length") == F.col("d"), F.col("c").cast("string")).otherwise("")
    return (
        nodes.join(summed, ["c", "d"], "left")
        .join(digests, ["c", "d"], "left")
        .join(lengths, "c")
        .select(
            F.col("c").alias("conv_id"),
            F.col("d").alias("depth"),
            F.col("parent").alias("parent_conv_id"),
            F.col("n").alias("n_convs"),
            "n_children",
            F.coalesce("n_leaves", F.lit(1)).cast("bigint").alias("n_leaves"),
            F.coalesce("saved_tokens", F.lit(0)).cast("bigint").alias("saved_tokens"),
            F.when(F.col("n") == 1, F.sha2(alone, 256))
            .otherwise(F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
            .alias("ends_sha256"),
        )
    )
