"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots of equally many words. Slot i has the golden-ratio lattice point of i, and the cumulative target
weights map the point to a source, so that every stretch of the mix is close to the targets. A source's slots are ranked;
the slot of rank r takes block r of that source's stream: its documents, shuffled by a hash of their ids, up to ``MOST``
times over, cut into blocks of the same number of words.

Defined results: a null text has size 0 and is never taken; a null source is a source, the last; a source without words
has target 0; repeated rows are documents of their own, in any order, as are documents of equal or null ids; a very long text
takes as many blocks as it fills; an empty table gives no rows; other columns of the input, whatever their names, are kept by
``remix`` and not read otherwise.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.common import load, packed, unpacked, written

#: Words of a slot and of a block.
BLOCK_WORDS = 64
#: Most times that a source or a document is taken.
MOST = 3
#: Weights of sources in code-point order, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: Neighbouring Fibonacci numbers: their ratio is the golden one, and their products fit a long.
FIB, FIB_BEFORE = 2971215073, 1836311903
#: Slots that are ranked together, and about how many documents of a source are added up together, so that no task holds a whole source.
CHUNK_SLOTS, PART_DOCS = 1 << 16, 1 << 12
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its size; what is above goes to the others by weight."""
    left, out, free = float(sum(sizes)), [0.0] * len(sizes), list(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


class Mix(NamedTuple):
    documents: DataFrame  # rid, row (what ``mix`` was told to carry), doc_id, size, s (source number), source_size, target
    sources: list  # (source, size, target), by source number
    pieces: DataFrame  # slot, s, block, rid, from_word, to_word (of the document)


def mix(docs: DataFrame, carry: Column | None = None, weights: tuple[float, ...] = WEIGHTS, block_words: int = BLOCK_WORDS) -> Mix:
    """The schedule of ``docs`` (doc_id, text, source and others), which keeps ``carry`` of each; per source only its size and its number of documents come to the driver."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    sized = docs.select(F.monotonically_increasing_id().alias("rid"), (F.lit(None) if carry is None else carry).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["source"].alias("source"), size.alias("size"))
    sized = written(sized if carry is not None else sized.drop("row"), "sized")
    got = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).orderBy(F.asc_nulls_last("source")).collect()
    sizes = [r["size"] for r in got]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))])
    sources = [(r["source"], r["size"], t) for r, t in zip(got, wanted)]
    # A row for each source, of which there are few: their targets are worked out here.
    table = spark.createDataFrame([(i, r["source"], r["size"], t, -(-r["n"] // PART_DOCS)) for i, (r, t) in enumerate(zip(got, wanted))], "s int, its string, source_size long, target double, parts int")
    numbered = sized.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("its"))).drop("its")

    # Slots and their ranks.
    total = sum(sizes)
    ends, run = [], 0.0
    for t in wanted[:-1]:
        run += t
        ends.append(run / total if total else 1.0)
    slots = spark.range(-(-total // block_words)).select(F.col("id").alias("slot"))
    point = ((F.col("slot") % FIB) * FIB_BEFORE % FIB).cast("double") / F.lit(float(FIB))
    cuts = F.array(*[F.lit(e) for e in ends]) if ends else F.array().cast("array<double>")
    slots = slots.select("slot", F.size(F.filter(cuts, lambda c: c <= point)).alias("s"), F.expr(f"slot div {CHUNK_SLOTS}").alias("chunk"))
    before = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = slots.groupBy("s", "chunk").agg(F.count(F.lit(1)).alias("n")).select("s", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    rank = F.row_number().over(Window.partitionBy("s", "chunk").orderBy("slot")) - 1
    ranked = slots.withColumn("_r", rank).join(starts, ["s", "chunk"]).select("slot", "s", (F.col("_r") + F.col("from")).alias("block"))

    # Streams: where each document begins in its source's shuffled order.
    stream = numbered.filter("size > 0").select("rid", "s", "source_size", "size", "parts", F.xxhash64(F.lit(17), F.col("doc_id"), F.col("size")).alias("h"), "doc_id")
    stream = stream.withColumn("part", F.pmod("h", F.col("parts")))
    before = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = stream.groupBy("s", "part").agg(F.sum("size").alias("n")).select("s", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("s", "part").orderBy("h", "doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = stream.withColumn("_to", F.sum("size").over(within)).join(firsts, ["s", "part"]).withColumn("at", F.col("first") + F.col("_to") - F.col("size"))
    times = F.explode(F.array(*[F.lit(e) for e in range(MOST)]))
    taken = placed.withColumn("_e", times).withColumn("a", F.col("at") + F.col("_e") * F.col("source_size")).withColumn("b", F.col("a") + F.col("size"))
    cut = taken.withColumn("block", F.explode(F.expr(f"sequence(a div {block_words}, (b - 1) div {block_words})")))
    low, high = F.greatest("a", F.col("block") * block_words), F.least("b", (F.col("block") + 1) * block_words)
    cut = cut.select("rid", "s", "block", (low - F.col("a")).alias("from_word"), (high - F.col("a")).alias("to_word"))
    return Mix(numbered, sources, ranked.join(cut, ["s", "block"]))


def taken_words(m: Mix) -> DataFrame:
    """The documents with ``taken``, the words that the mix takes of each, repeats counted."""
    taken = m.pieces.groupBy("rid").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    return m.documents.join(taken, "rid", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))


def remix(docs: DataFrame) -> DataFrame:
    """``docs``, its columns as they are, each row as often as the mix takes its words, to the nearest whole number."""
    rows = taken_words(mix(docs, packed(docs))).withColumn("times", F.round(F.try_divide("taken", "size")).cast("int")).filter("times > 0")
    return unpacked(rows.select("row", F.explode(F.sequence(F.lit(1), "times"))), docs)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(load(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return taken_words(m).select("doc_id", "size", "source_size", "target", "taken")
