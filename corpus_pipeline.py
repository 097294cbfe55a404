"""A corpus pipeline: toxic documents go, one of each near-duplicate group stays, benchmark text goes, sources are mixed, tokens are written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm.common import load, written
from kinfold.llm.decontaminate import keep_clean
from kinfold.llm.mixing import remix
from kinfold.llm.neardup import keep_one
from kinfold.llm.token_output import default_tokenizer, token_output
from kinfold.llm.toxicity import reject, training_labels
from kinfold.plans.tables import swept


# Of all stages: ``docs`` has the columns of documents and maybe more, of any names, which all stages but the last return as
# they are. Nulls may stand in any column, ids may be null or repeated, texts empty or very long; an empty table stays empty.


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that don't score as toxic. Labels without an id, a label or a document teach nothing; a null text is an empty one, which is toxic only if most such examples are; equal texts fare alike."""
    return reject(docs, training_labels(load(spark, sf_dir, "labels", "doc_id", "toxic"), "toxic"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-equal texts: that of the least id, null ids last. Texts without words, null or empty ones among them, are near their equals only; of repeated rows one stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of a benchmark item; items without an id are searched for as well, items without a text have none. A null text has no window."""
    return keep_clean(docs, load(spark, sf_dir, "benchmark", "item_id", "text"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes its words, to the nearest whole number; rows without words are never taken. A null source is a source of its own; repeated rows are rows of their own."""
    return remix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, read from the files that it writes. A null text is the end id alone; null ids come first; repeated ids are written each, in order of their texts."""
    return token_output(docs.select("doc_id", "text"), default_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]
#: Neither the votes of neighbours nor the tokenizer can be put in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's own tables go when it has been written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with swept(spark) as kept:
            docs = written(stage(spark, docs, sf_dir), name)
            kept.append(docs)
    return docs
