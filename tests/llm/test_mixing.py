import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pagetables.llm.mixing import apportion, mixed, take_mix
from tests.llm.data import DOCS, awkward, awkward_rows, empty, prose


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes):
    """Excess over three times the size is shared again by weight, until none is left."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left, sum_w = total - sum(target.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if Fraction(left * weight[s], sum_w) > 3 * sizes[s]}
        if not over:
            target |= {s: Fraction(left * weight[s], sum_w) for s in open_}
            break
        target |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    return target


def some_rows(n=300, seed=1):
    rng = random.Random(seed)
    return [
        (i, prose(rng, rng.choice((0, 3, 40, 300 if i % 50 else 4000))), "en", rng.choice(["b", "a", None, "ä", "Z"] + ["big"] * 20), 1)
        for i in range(n)
    ]


def check(rows, found, block=64):
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    target = plain_targets(sizes)
    assert len(found) == len(rows)
    taken = {}
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(float(target[r["source"]]))
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    shards = len({(r["source"], r["shard"]) for r in found})
    for s, t in taken.items():
        assert abs(t - target[s]) <= block * (shards + 1)
    return taken


@pytest.mark.parametrize("shard", [2000, 2_000_000])
def test_targets_and_quotas(spark, shard):
    rows = some_rows()
    frame = spark.createDataFrame(rows, DOCS)
    found = mixed(frame, shard=shard, block=16).collect()
    check(rows, found, 16)
    again = mixed(frame.repartition(7), shard=shard, block=16).collect()
    key = lambda r: r["doc_id"]
    assert sorted(found, key=key) == sorted(again, key=key)


def test_awkward_rows(spark):
    check(awkward_rows(), mixed(awkward(spark).withColumn("source", F.col("source"))).collect())
    assert mixed(empty(spark)).collect() == []
    blank = spark.createDataFrame([(1, None, "en", "a", 0), (2, " ", "en", None, 0)], DOCS)
    assert {(r["doc_id"], r["target"], r["taken"]) for r in mixed(blank).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1003])
def test_sainte_lague(spark, seats):
    rng = random.Random(seats)
    votes = {g: {f"n{i}": rng.choice((0, 1, rng.randrange(1, 5000))) for i in range(rng.randrange(1, 9))} for g in range(6)}
    rows = [(g, n, v) for g, each in votes.items() for n, v in each.items()]
    frame = spark.createDataFrame(rows, "g int, n string, v bigint")
    got = {(r["g"], r["n"]): r["seats"] for r in apportion(frame, ["g"], ["n"], "v", F.lit(seats), "seats").collect()}
    for g, each in votes.items():
        given = dict.fromkeys(each, 0)
        if sum(each.values()):
            for _ in range(seats):
                best = max(sorted(each), key=lambda n: Fraction(each[n], 2 * given[n] + 1))
                given[best] += 1
        assert {n: got[g, n] for n in each} == given


def test_stage_returns_what_is_taken(spark):
    rows = some_rows()
    taken = {r["doc_id"]: r["taken"] for r in mixed(spark.createDataFrame(rows, DOCS)).collect()}
    out = take_mix(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"]: r["taken"] for r in out} == {d: t for d, t in taken.items() if t}
    assert {r["doc_id"]: r["text"] for r in out} == {d: t for d, t, *_ in rows if taken[d]}
