import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagetables.llm.queries import CHECKS, QUERIES
from tests.llm.data import DOCS, awkward, empty, prose
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_secret_scan import plain_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ITEMS = "item_id bigint, text string"
LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(31)
    rows, labels = [], []
    items = [(i, prose(rng, 25)) for i in range(5)]
    for i in range(300):
        text, good = prose(rng, rng.randrange(40, 120)), i % 5 != 0
        if not good:
            text = text.upper().replace(" ", "!! ")
        elif i % 9 == 1:
            text += " " + items[i % 5][1]
        elif i % 9 == 2:
            text += f' token = "{rng.getrandbits(160):040x}"'
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, int(good), 0))
    rows += [(1000 + i, t, *rest) for i, (_, t, *rest) in enumerate(rows[:100])]
    path = tmp_path_factory.mktemp("tables")
    for name, data, shape in (("documents", rows, DOCS), ("benchmark", items, ITEMS), ("labels", labels, LABELS)):
        spark.createDataFrame(data, shape).write.parquet(f"{path}/{name}.parquet")
    return str(path), rows, items


def test_stages_against_plain_versions(spark, tables):
    path, rows, items = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)
    assert len(names) == 5

    good = stages[names[0]](spark, docs, path)
    assert good.columns == COLUMNS
    kept = [tuple(r) for r in good.collect()]
    assert {r[0] % 1000 for r in kept} == {d for d in range(300) if d % 5}

    alone = stages[names[1]](spark, good, path)
    assert alone.columns == COLUMNS
    first = {}
    for r in sorted(kept):
        first.setdefault(r[1], r)
    kept = list(first.values())
    assert sorted(tuple(r) for r in alone.collect()) == sorted(kept)

    clean = stages[names[2]](spark, alone, path)
    assert clean.columns == COLUMNS
    kept = [r for r in kept if not contaminated([r], items)[0][5]]
    assert sorted(tuple(r) for r in clean.collect()) == sorted(kept) and 100 < len(kept) < 240

    safe = stages[names[3]](spark, clean, path)
    assert safe.columns == COLUMNS
    found = {r["doc_id"]: r for r in safe.collect()}
    assert found.keys() == {r[0] for r in kept}
    for d, text, *_ in kept:
        assert (found[d]["text"] == text) == (not plain_spans(text)) and not plain_spans(found[d]["text"])
        assert found[d]["n_chars"] == len(found[d]["text"])

    mix = stages[names[4]](spark, safe, path).collect()
    out = {r["doc_id"]: r for r in mix}
    assert len(out) == len(mix) and out.keys() <= found.keys()
    whole = corpus_pipeline.run(spark, path).collect()
    assert sorted(map(str, whole)) == sorted(map(str, mix))


def test_awkward_documents(spark, tables):
    path, *_ = tables
    for docs in (awkward(spark).select(*COLUMNS), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, path)
        docs.collect()


def test_clashing_names_in_every_stage(spark, tables, tmp_path):
    path, *_ = tables
    docs = awkward(spark).withColumn("target", F.lit("x")).withColumn("quality", F.lit("x"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    assert {"size", "target", "taken", "quality", "root"} <= set(docs.columns)


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert CHECKS.keys() <= QUERIES.keys()
