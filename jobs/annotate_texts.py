"""Annotation of text records with their best reference family, by shared runs of words.

    python -m jobs.annotate_texts --records PATH --families PATH --output DIR [--config FILE]

``records`` has the columns of ``documents``: a record is known by source (its genome) and doc_id, rows of one such pair
are its parts. ``families`` has those of ``benchmark``: a family is an item_id with its texts. Words are what
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` finds after lower-casing A-Z; a run is ``words`` of them in a row, or all words
of a text that has fewer, but some.

A record's hit on a family has as identity the share of the family's distinct runs that the record has, and as aligned
places those from the first to the last shared run on either side. Hits below the identity or coverage (per cent, at most
1: fraction; the lesser of both sides) of the config go; the best one holds: identity, then shared runs, then family.

Output, Parquet partitioned by source, which a rerun overwrites with the same rows:

* ``annotations``: source, doc_id, family, identity, coverage, shared_runs, n_words of each record with a hit;
* ``families``: source, family, n_records.

Rows with a null id or text are left out; a null source is a source. The whole text of every row is read. Runs of words
meet in one join on the run; the families' distinct runs are written before it, so that Spark broadcasts them if they are
small. What is shared is aggregated by record and family, on the map side first.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, default_config, load_config, make_empty
from kinfold.operators.annotate import best_annotation
from kinfold.plans.tables import swept, written

log = logging.getLogger("annotate_texts")

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANNOTATIONS = "source string, doc_id long, family long, identity double, coverage double, shared_runs long, n_words long"
FAMILIES = "source string, family long, n_records long"


@dataclass(frozen=True)
class Config:
    words: int  # of a run
    identity: float
    coverage: float
    rows_per_file: int


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, CAPITALS, SMALL), F.lit(WORD), F.lit(0))


def runs(rows: DataFrame, key: list[str], k: int) -> DataFrame:
    """(key, run, first, last): each run of a row's text, with the places of its first and last word, from 0."""
    listed = rows.select(*key, word_list(F.col("text")).alias("w"))
    listed = listed.select(*key, "w", F.least(F.size("w"), F.lit(k)).alias("n"))  # counted here: a row of each run would carry all words otherwise
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (k - 1), F.lit(1)))
    each = F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, k), " "))).alias("first", "run")
    # Texts without words have an empty run; asking for their words instead would look for all words twice.
    return listed.select(*key, "n", each).filter("run <> ''").select(*key, "run", "first", (F.col("first") + F.col("n") - 1).alias("last"))


def hits(records: DataFrame, families: DataFrame, k: int) -> DataFrame:
    """Rows as ``best_annotation`` takes them: (query, subject, pident, qstart, qend, sstart, send, q_len, s_len, evalue, bitscore)."""
    key, spans = ["source", "doc_id"], [F.min("first").alias("first"), F.max("last").alias("last")]
    # Written, so that Spark knows its size: a small one is broadcast, and records' runs are dropped where they are read.
    theirs = written(runs(families, ["item_id"], k).groupBy("item_id", "run").agg(*spans), "family-runs")
    sizes = theirs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_runs"))
    words = families.groupBy("item_id").agg(F.sum(F.size(word_list(F.col("text")))).alias("s_len")).join(sizes, "item_id")
    both = runs(records, key, k).join(theirs.select("item_id", "run", F.col("first").alias("f"), F.col("last").alias("l")), "run")
    once = both.groupBy(*key, "item_id", "run", "f", "l").agg(*spans)
    ends = [F.min("first").alias("qstart"), F.max("last").alias("qend"), F.min("f").alias("sstart"), F.max("l").alias("send")]
    found = once.groupBy(*key, "item_id").agg(F.count(F.lit(1)).alias("bitscore"), *ends).join(words, "item_id")
    found = written(found.withColumnRenamed("source", "_source").withColumnRenamed("doc_id", "_id"), "family-hits")
    same = F.col("_source").eqNullSafe(F.col("source")) & (F.col("_id") == F.col("doc_id"))
    lengths = records.join(found, same, "left_semi").groupBy(*key).agg(F.sum(F.size(word_list(F.col("text")))).alias("q_len"))
    whole = found.join(lengths, same)
    pident = F.col("bitscore") * F.lit(100.0) / F.col("n_runs")
    return whole.select(F.struct("source", "doc_id").alias("query"), F.col("item_id").alias("subject"), pident.alias("pident"), "qstart", "qend", "sstart", "send", "q_len", "s_len", F.lit(0.0).alias("evalue"), "bitscore")


def annotated(records: DataFrame, families: DataFrame, config: Config) -> DataFrame:
    """The best family of each record that has one."""
    rows = records.select("source", F.col("doc_id").cast("long").alias("doc_id"), "text").dropna(subset=["doc_id", "text"])
    items = families.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna(subset=["item_id", "text"])
    best = best_annotation(hits(rows, items, config.words), config.identity, config.coverage)
    return best.select("query.source", "query.doc_id", F.col("subject").alias("family"), F.col("pident").alias("identity"), "coverage", F.col("bitscore").alias("shared_runs"), F.col("q_len").alias("n_words"))


def read_annotations(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(ANNOTATIONS).parquet(f"{output}/annotations")


def run(spark: SparkSession, records: str, families: str, output: str, config: Config) -> dict[str, int]:
    """Annotates all rows of ``records``. Returns the numbers of rows read and written."""
    read = spark.read.parquet(records).select("source", "doc_id", "text")
    log.info("reading %s and %s", records, families)
    make_empty(spark, f"{output}/annotations", ANNOTATIONS, ["source"])
    make_empty(spark, f"{output}/families", FAMILIES, ["source"])
    with swept(spark):
        found = annotated(read, spark.read.parquet(families).select("item_id", "text"), config)
        # Sources without a hit any more must not keep those of an earlier run.
        found.hint("rebalance", "source").write.mode("overwrite").option("maxRecordsPerFile", config.rows_per_file).partitionBy("source").parquet(f"{output}/annotations")
    kept = read_annotations(spark, output)
    kept.groupBy("source", "family").agg(F.count(F.lit(1)).alias("n_records")).hint("rebalance", "source").write.mode("overwrite").partitionBy("source").parquet(f"{output}/families")
    done = {"records": read.count(), "annotated": kept.count(), "families": spark.read.schema(FAMILIES).parquet(f"{output}/families").count()}
    log.info("read %(records)d rows, wrote %(annotated)d annotations and %(families)d counts", done)
    return done


def main() -> None:
    args = command_line("Best reference family of each text record.", ["records", "families", "output"])
    spark = SparkSession.builder.appName("annotate-texts").getOrCreate()
    config = load_config(spark, args["config"], Config) if args["config"] else default_config(__file__, Config)
    run(spark, args["records"], args["families"], args["output"], config)
    spark.stop()


if __name__ == "__main__":
    main()
