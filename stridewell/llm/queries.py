"""One query for each operator, over its whole table with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chosen_path, html, lexical, mixing, packing, pieces, pii, quality, repair, substrings, token_output, topk, toxicity
from .common import read


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.documents_in_order(read(spark, sf_dir, "documents"))


def op2_super_k_mers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.documents(read(spark, sf_dir, "documents"))


def op3_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.documents(read(spark, sf_dir, "documents"))


def op4_levenshtein_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.join(read(spark, sf_dir, "documents"))


def op6_fair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(read(spark, sf_dir, "documents"))


def op7_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op8_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.every_hundredth(read(spark, sf_dir, "embeddings"))


def op9_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op10_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(read(spark, sf_dir, "documents"))


def op11_quantised_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


def op12_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode(read(spark, sf_dir, "documents")))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_training_order": op1_training_order,
    "op2_super_k_mers": op2_super_k_mers,
    "op3_skip_chain": op3_skip_chain,
    "op4_levenshtein_lexicon": op4_levenshtein_lexicon,
    "op5_chosen_path": op5_chosen_path,
    "op6_fair_mixing": op6_fair_mixing,
    "op7_block_rules": op7_block_rules,
    "op8_threshold_search": op8_threshold_search,
    "op9_decision_list": op9_decision_list,
    "op10_vector_packing": op10_vector_packing,
    "op11_quantised_index": op11_quantised_index,
    "op12_prefix_tokens": op12_prefix_tokens,
    "op13_turn_repair": op13_turn_repair,
}
ORACLES: dict[str, str] = {"op8_threshold_search": topk.ORACLE, "op11_quantised_index": lexical.ORACLE, "op13_turn_repair": repair.ORACLE}
