"""A corpus pipeline of five stages: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept and returns a DataFrame; all but the last return the
columns of documents. The result of a stage is written as Parquet in the shared folder and read again by the next, after which it is deleted.

Defined cases, for every stage: a null or empty text is a document without words, which the quality rules reject (the other stages keep it as
it is, near-dedup as one group); very long texts are processed whole; repeated rows and ids are rows of their own, of which near-dedup keeps
one; a null doc_id is carried; an empty table gives an empty table with the same columns; other columns, whatever their names, are
carried along until packing, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hiregrid.llm.common import discard, table, written
from hiregrid.llm.decontaminate import remove_contaminated
from hiregrid.llm.lines import drop_recurring_lines
from hiregrid.llm.packing import best_fit_pack
from hiregrid.llm.quality import keep_good
from hiregrid.llm.queries import TOKENIZER
from hiregrid.llm.near import keep_one_similar


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of templates that recur across documents; n_chars is counted anew."""
    return drop_recurring_lines(docs, length_col="n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (SimHash candidates of five-word shingles, verified similarity of 0.8 or more): the one with the smallest doc_id."""
    return keep_one_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, placed in sequences."""
    return best_fit_pack(docs, TOKENIZER)


STAGES = [("quality rules", quality), ("line dedup", lines), ("simhash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("best-fit packing", pack)]

#: The stages aren't SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
