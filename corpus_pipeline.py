"""Documents to a training mix: quality, near copies, benchmarks, secrets, source weights.

Every stage gets what the one before kept.  All but the last return the columns of
``documents``; the last adds how many words of a document the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagetables.llm.common import load, settled
from pagetables.llm.decontaminate import without_contaminated
from pagetables.llm.mixing import take_mix
from pagetables.llm.quality_model import keep_quality
from pagetables.llm.secret_scan import redact
from pagetables.llm.simhash_groups import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt on the labelled ones among them, does not reject."""
    return keep_quality(docs, load(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words in a row with a benchmark item."""
    return without_contaminated(docs, load(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with ``size``, ``target`` and ``taken``."""
    return take_mix(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("source mix", mix),
]

#: No SQL for a learnt classifier; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
