"""A training corpus from documents: without toxic texts and near copies, redacted, mixed and packed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stridewell.llm import chosen_path, mixing, packing, pii, toxicity
from stridewell.llm.common import read, removed, tables, with_length, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from those of them that have labels, doesn't reject.

    Null and empty texts stay; repeated rows stay or go together; all columns, of whatever names, stay. Without labelled
    documents nothing is rejected; an empty table gives an empty result.
    """
    return toxicity.accepted(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each group of near copies: of the least doc_id, the least set.

    Repeated rows are copies; a doc_id that stands for several texts goes by each of them. Rows without words or without
    doc_id all stay; all columns, of whatever names, stay; an empty table gives an empty result.
    """
    return chosen_path.deduplicated(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text.

    Null texts stay null; repeated rows and null doc_ids are documents of their own; all columns, of whatever names,
    stay; an empty table gives an empty result.
    """
    return with_length(pii.find(docs, pii.fit(docs), redact=True))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one in which the budget ends is cut there; n_chars follows the text.

    Documents without words are never taken; a null source is a source of its own; repeated rows are documents of their
    own; all columns, of whatever names, stay; an empty table gives an empty result.
    """
    return with_length(mixing.mixed_copies(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences.

    A null or empty text has the piece of its end mark; repeated rows are documents of their own; of the columns only
    doc_id and text count; an empty table gives an empty result.
    """
    return packing.packed_documents(docs)


STAGES: list[tuple[str, Stage]] = [("toxicity", toxic), ("jaccard_join", near_copies), ("pii", private), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's result is written to the shared folder before the next reads it.

    What a stage has written on the way, and its predecessor's result, is removed when its own result stands.
    """
    docs = read(spark, sf_dir, "documents")
    before = tables()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        removed(spark, [t for t in tables()[:-1] if t not in before])
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned models, similarity and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
