"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; between stages
the rows are written as Parquet in the shared folder and read again.

Every stage takes nulls in any column, empty and very long texts, repeated rows, an empty table and
further columns of any name, and gives the columns back as they were. A null text counts as empty; it is not
toxic, loses no line, is no near copy and holds no benchmark item, so it goes to the end and is packed as the
end id alone. A row without a doc_id is judged by its text like any other, but is nobody's near copy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import decontamination, line_dedup, near_duplicates, packing, toxicity
from leadloom.llm.common import stage, table
from leadloom.llm.tokenize import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not score as toxic, learnt from the labels that may be learnt from; equal texts share their score."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share; n_chars follows the text. All documents stay, if with an empty text."""
    cut = line_dedup.dedup_lines(docs).select(docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near copies; of rows that repeat that doc_id one."""
    return near_duplicates.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows that repeat a doc_id go together."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their places in packed sequences; rows that repeat a doc_id are documents of their own."""
    return packing.checksums(packing.pack(docs, vocabulary("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`: the pieces of those that stay, a row each. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The toxicity classifier and the tokenizer are beyond SQL.
ORACLE_SQL: str | None = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
