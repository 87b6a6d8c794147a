"""Quality rules whose cutoffs come from quantile sketches of each language and source.

A sketch counts the values of a measure in buckets that grow by ``GROWTH``; sketches merge by
adding counts, so they are built with partial aggregation and a hot source costs no more
than its buckets.  Quantiles read from it are within one bucket of the exact ones.  The
fences of a group are its quartiles and three times its spread, which is the distance of the
quartiles or that of the median from the quantile ``TAIL`` beyond it.

Most groups have no symbols or repeats in most documents, so these distances are zero.  A
share can't be told apart finer than by one occurrence in a document, so the spread is at
least one occurrence in a small document of the group: its sizes, in words and lines, have
sketches too, and their quantile ``TAIL`` is such a size.  A document outside the fences, or
failing the base rule, is not kept.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetables.llm.common import pick, settled, utf8

#: Ratio of a bucket's bounds: quantiles are within one per cent.
GROWTH = 1.02
#: Multiples of the spread between a quartile and its fence.
REACH = 3.0
#: Share of the documents beyond the outer quantile, on each side.
TAIL = 0.15
#: Least distance of the word length's lower and upper fence from the quartiles, in medians.
WORD_LENGTH = (0.4, 1.0)
#: The other measures have an upper fence: the size whose share they are, and of how much of it
#: one occurrence takes (a repeat is two windows of three words).
OCCURRENCE: dict[str, tuple[str, int]] = {
    "symbol_share": ("words", 1),
    "dup_line_share": ("lines", 1),
    "repeat_share": ("words", 6),
}
#: The base rule.
LEAST_WORDS = 50
MOST_REPEATED = 0.5

_SYMBOLS = b"#*$%&|<>"
_BLANKS = b"\t\n\x0b\x0c\r "


def measures(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (with a word)
    of a UTF-8 text."""
    words = text.split()
    letters = text.translate(None, _BLANKS)
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(_BLANKS):
            seen.add(line)
    repeated = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:]))
        counts = Counter(windows)
        if len(counts) < len(windows):
            covered = 0  # words up to here are counted
            for i, window in enumerate(windows):
                if counts[window] > 1:
                    repeated += i + 3 - max(i, covered)
                    covered = i + 3
    return len(words), len(letters.decode()), symbols, dup, repeated, dup + len(seen)


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_COUNTS = (*_NAMES, "n_lines")


def document_measures(docs: DataFrame) -> DataFrame:
    """The measures of every row, with ``doc_id``, ``lang`` and ``source``."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch["text"])
            raw, at = data.tobytes(), at.tolist()
            rows = [measures(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            cols = zip(*rows, strict=True) if rows else [()] * len(_COUNTS)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["lang"], batch["source"], *(pa.array(c, pa.int64()) for c in cols)],
                ["doc_id", "lang", "source", *_COUNTS],
            )

    return pick(docs, doc_id="bigint", text="string", lang="string", source="string").mapInArrow(
        measure, "doc_id bigint, lang string, source string, " + ", ".join(f"{n} bigint" for n in _COUNTS)
    )


def _shares() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "word_length": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
    }


def sketches(rows: DataFrame) -> DataFrame:
    """Counts by language, source, measure and bucket; the sum of two such tables is their merger."""
    sizes = {"words": F.col("n_words").cast("double"), "lines": F.col("n_lines").cast("double")}
    values = {**_shares(), **sizes}
    each = F.explode(
        F.array(*(F.struct(F.lit(name).alias("measure"), value.alias("value")) for name, value in values.items()))
    )
    bucket = F.when(F.col("m.value") > 0, F.ceil(F.log(F.col("m.value")) / math.log(GROWTH)).cast("int"))
    return (
        rows.where("n_words > 0")
        .select("lang", "source", each.alias("m"))
        .groupBy("lang", "source", F.col("m.measure").alias("measure"), bucket.alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def fences(sketch: DataFrame) -> DataFrame:
    """Lower and upper fence of every measure of a language and source, in one row."""
    group = W.partitionBy("lang", "source", "measure")
    # The bucket of zero is null and the least.
    upto = F.sum("n").over(group.orderBy(F.col("bucket").asc_nulls_first()))
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(
        F.pow(F.lit(GROWTH), F.col("bucket")) * (2 / (1 + GROWTH))
    )
    ranked = sketch.select(
        "lang", "source", "measure", value.alias("value"), upto.alias("upto"), F.sum("n").over(group).alias("all")
    )
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), F.col("value")))
    quantiles = ranked.groupBy("lang", "source", "measure").agg(
        *(at(q).alias(name) for name, q in (("least", TAIL), ("low", 0.25), ("mid", 0.5), ("high", 0.75), ("most", 1 - TAIL)))
    )
    between = F.col("high") - F.col("low")
    below = F.greatest(REACH * F.greatest(between, F.col("mid") - F.col("least")), WORD_LENGTH[0] * F.col("mid"))
    spread = F.greatest(between, F.col("most") - F.col("mid"))
    of = lambda name, value: F.max(F.when(F.col("measure") == name, value))
    groups = quantiles.groupBy("lang", "source").agg(
        of("word_length", F.col("low") - below).alias("word_length_from"),
        of("word_length", F.col("high") + F.greatest(REACH * spread, WORD_LENGTH[1] * F.col("mid"))).alias("word_length_to"),
        *(of(size, F.col("least")).alias(f"small_{size}") for size in ("words", "lines")),
        *(of(name, F.col("high")).alias(f"{name}_high") for name in OCCURRENCE),
        *(of(name, spread).alias(f"{name}_spread") for name in OCCURRENCE),
    )
    return groups.select(
        "lang",
        "source",
        "word_length_from",
        "word_length_to",
        *(
            (F.col(f"{name}_high") + REACH * F.greatest(F.col(f"{name}_spread"), takes / F.col(f"small_{size}")))
            .alias(f"{name}_to")
            for name, (size, takes) in OCCURRENCE.items()
        ),
    )


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measures, ``base_failed``, ``kept`` and ``outside`` (measures beyond a fence) of every row.

    Null and empty texts have no words, so they fail the base rule; they do not enter the
    sketches.  A null language or source is a group of its own.  Repeated rows count as
    often as they come and are all returned.  Other columns are ignored.
    """
    rows = settled(document_measures(docs), "measures")
    limits = fences(sketches(rows)).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = rows.join(
        limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left"
    )
    shares, beyond = _shares(), []
    for name in shares:
        out = shares[name] > F.col(f"{name}_to")
        if name == "word_length":
            out = out | (shares[name] < F.col("word_length_from"))
        beyond.append(F.when(out, F.lit(name)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 100 * MOST_REPEATED * F.col("n_words"))
    outside = F.array_compact(F.array(*beyond))
    return joined.select(
        "doc_id",
        *_NAMES,
        failed.alias("base_failed"),
        (~failed & (F.size(outside) == 0)).alias("kept"),
        outside.alias("outside"),
    )
