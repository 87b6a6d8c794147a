"""Small inputs that the tests of the training-data operators share."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "amber birch cedar delta ember fjord grove heath inlet jetty knoll larch marsh north ocean pines quartz ridge slope thorn".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    same = prose(rng, 60)
    return [
        (1, same, "en", "a", 1),
        (2, same, "en", "a", 1),
        (2, same, "en", "a", 1),
        (3, None, None, None, None),
        (4, "", "en", None, 0),
        (5, " \t\n ", None, "b", 3),
        (6, long, "de", "b", 5),
        (7, long + " tail", "de", "b", 5),
        (None, same, "en", "a", None),
        (None, None, None, None, None),
        (8, "één ßüñ 漢字 \U0001f600 text", "fr", "c", 9),
        (9, "zero\x00byte \x7f and " + same, "en", "c", 9),
    ]


def awkward(spark):
    """The rows with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(awkward_rows(), DOCS)
    for name in ("fp", "part", "kind", "k", "blob", "rid", "hits", "size", "score", "taken", "root", "node", "_dropped", "url"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


def empty(spark):
    return spark.createDataFrame([], DOCS)
