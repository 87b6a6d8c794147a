"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetables.llm.checks import CHECKS
from pagetables.llm.common import load, settled
from pagetables.llm.decontaminate import contamination
from pagetables.llm.html_wrappers import page_texts
from pagetables.llm.license_scan import license_scan
from pagetables.llm.mixing import mixed
from pagetables.llm.prefix_trie import prefix_trie
from pagetables.llm.quality_model import quality_scores
from pagetables.llm.quality_rules import judged
from pagetables.llm.secret_scan import find_secrets
from pagetables.llm.simhash_groups import near_groups
from pagetables.llm.suffix_dedup import remove_repeats
from pagetables.llm.token_alignment import alignment
from pagetables.llm.token_counts import token_counts
from pagetables.llm.warc import capture_histories, in_order

__all__ = ["CHECKS", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(load(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents")).drop("kept")


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(load(spark, sf_dir, "documents"))


def op5_warc_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at")
    found = capture_histories(load(spark, sf_dir, "pages")).select(*result, "range_no", "place")
    return in_order(settled(found, "captures")).select(*result, "position")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.drop("items", "rid")


def op7_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(load(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(load(spark, sf_dir, "documents")).withColumn("outside", F.concat_ws(",", "outside"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(load(spark, sf_dir, "documents")).drop("source", "shard", "rid")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(load(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(load(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return alignment(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(load(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_secret_scan": op2_secret_scan,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_simhash_groups": op4_simhash_groups,
    "op5_warc_histories": op5_warc_histories,
    "op6_decontamination": op6_decontamination,
    "op7_html_wrappers": op7_html_wrappers,
    "op8_quality_rules": op8_quality_rules,
    "op9_source_mix": op9_source_mix,
    "op10_license_scan": op10_license_scan,
    "op11_token_counts": op11_token_counts,
    "op12_token_alignment": op12_token_alignment,
    "op13_prefix_trie": op13_prefix_trie,
}
