"""Documents made ready for training, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns a DataFrame, which is written as
Parquet and read again. All but the last return the columns of ``documents``. Null, empty and repeated rows are treated as the
operators say; empty tables give no rows.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lexforge.llm import near_dedup, packing, quality_mil, quality_rules, sanitise
from lexforge.llm.shared import bounded_batches, free, made_since, table, written

_left: set[str] = set()


def _stage(work):
    """``work``, after which its tables are known, and before which those of the stages before it go, unless ``docs`` still reads them."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _left
        bounded_batches(spark)
        if _left and not any(t.rsplit("/", 1)[-1] in f for f in docs.inputFiles() for t in _left):
            free(*_left)
            _left = set()
        before = made_since()
        out = work(spark, docs, sf_dir)
        _left |= made_since(before)
        return out

    return run_stage


@_stage
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the quality rules keep, with all columns.

    Null and empty texts have too few words and go; texts are judged whole. Equal texts of one language have one verdict. A null language is one of its own.
    """
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the classifier keeps, with all columns; it learns from the labelled documents among ``docs``.

    A null text is scored as an empty one; equal texts have equal scores, and a score of just the cut stays. Without labels all scores are one half, and all documents stay.
    """
    return quality_mil.good_documents(docs, table(spark, sf_dir, "labels"))


@_stage
def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, with all columns: that of the smallest doc_id, null ones last; of equal ones the first read.

    Null and empty texts are near-duplicates of nothing and stay. Repeated rows are copies.
    """
    return near_dedup.one_of_each(docs)


@_stage
def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data, and terms that disclose them, replaced; ``n_chars`` follows the text, all other columns stay.

    Null texts stay null. Equal texts become equal texts; spans that overlap go under one mark.
    """
    return sanitise.clean_documents(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and where they lie in the training sequences.

    A null text is an empty one, which is one piece of one id. Repeated rows and null doc_ids are documents of their own. Of bins that fit equally well any may take a piece.
    """
    return packing.packed(docs)


STAGES = [("rules", rules), ("quality", quality), ("dedup", dedup), ("pii", pii), ("pack", pack)]
#: SQL can express neither the trained classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
