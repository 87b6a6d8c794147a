import random
import zlib

from pyspark.sql import functions as F

from pagetables.llm.quality_model import fit, keep_quality, quality_scores, words_of
from tests.llm.data import DOCS, awkward, empty, prose

LABELS = "doc_id bigint, quality int, toxic int, text string"


def good_and_bad(n=400, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text, good = prose(rng, rng.randrange(30, 90)), i % 4 != 0
        if not good:
            text = text.upper().replace(" ", "!! ") if i % 8 else (text.split()[0] + " ") * 40
        rows.append((i, text, "en", "s", 1))
        labels.append((i, int(good), 0, "not used"))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = good_and_bad(900)
    truth = {d: q for d, q, *_ in labels}
    found = quality_scores(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    unseen = [r for r in found if r["held_out"]]
    assert len(unseen) > 50
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in unseen) >= 0.95 * len(unseen)


def test_held_out_labels_do_not_matter(spark):
    rows, labels = good_and_bad(200)
    other = [(d, 1 - q if zlib.crc32(str(d).encode()) % 4 == 2 else q, t, x) for d, q, t, x in labels]
    docs = spark.createDataFrame(rows, DOCS)
    a, b = (
        {r["doc_id"]: round(r["score"], 9) for r in quality_scores(docs, spark.createDataFrame(x, LABELS)).collect()}
        for x in (labels, other)
    )
    assert a == b


def test_awkward_rows(spark):
    _, labels = good_and_bad(8)
    few = spark.createDataFrame(labels, LABELS)
    found = quality_scores(awkward(spark), few).collect()
    assert len(found) == 12 and len({r["score"] for r in found}) == 1
    assert quality_scores(empty(spark), few.limit(0)).collect() == []
    rows, labels = good_and_bad()
    learnt = spark.createDataFrame([(d + 100, *x) for d, *x in rows], DOCS)
    more = spark.createDataFrame([(d + 100, *x) for d, *x in labels] + [(None, 1, 0, ""), (1, None, 0, ""), (100, 1, 0, "")], LABELS)
    docs = awkward(spark).select("doc_id", "text", "lang", "source", "n_chars").union(learnt)
    found = quality_scores(docs, more).collect()
    assert len(found) == 412 and all(0 <= r["score"] <= 1 for r in found)


def test_stage_keeps_rows_and_columns(spark):
    rows, labels = good_and_bad()
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("mine"))
    kept = keep_quality(docs, spark.createDataFrame(labels, LABELS)).collect()
    ids = {r["doc_id"] for r in quality_scores(docs, spark.createDataFrame(labels, LABELS)).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept} == ids and kept[0]["score"] == "mine"


def test_probabilities_are_calibrated():
    rng = random.Random(1)
    texts, labels = [], []
    for _ in range(2000):
        noisy = rng.random() < 0.5
        texts.append(prose(rng, 40) + (" !!" * 20 if noisy else ""))
        labels.append(int(rng.random() < (0.3 if noisy else 0.9)))
    model = fit(texts, labels)
    score = model.score(model.pooled(texts, {}))
    for noisy, share in ((True, 0.3), (False, 0.9)):
        part = [s for s, t in zip(score, texts, strict=True) if t.endswith("!!") == noisy]
        assert abs(sum(part) / len(part) - share) < 0.08


def test_words():
    assert words_of("Don't, été_9 12!") == ["Don", "'", "t", ",", "été", "_", "9", "12", "!"]
