"""Sharding by weighted rendezvous hashing, in DataFrame functions alone.

Each key scores every shard with ``-ln(u) / weight``, where ``u`` in (0, 1) comes from the md5 of key and shard,
and goes to the lowest score. A key's shard depends on the key and the shards alone; a further shard takes keys
only into itself; a removed one gives up only its own.

Defined results: a null key is the key ``''``; a null text has size 1 and the crc32 of no bytes; repeated rows get
a slot each; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.common import load

#: Groups of keys within a shard whose rows are numbered apart; a group is one task's work.
BUCKETS = 256
#: Hex digits of the md5 that make ``u``: 52 bits, exact in a double.
DIGITS = 13


def rendezvous(key: Column, shards: Sequence[tuple[int, float]], salt: str = "") -> Column:
    """The (score, shard) of the winning shard; compare with ``least`` to add shards."""
    if not shards or any(w <= 0 for _, w in shards):
        raise ValueError("every shard needs a positive weight")
    text = F.coalesce(key.cast("string"), F.lit(""))

    def score(shard: int, weight: float) -> Column:
        digits = F.substring(F.md5(F.concat(text, F.lit(f"{salt}:{shard}")).cast("binary")), 1, DIGITS)
        u = (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(16**DIGITS))
        return F.struct((-F.log(u) / F.lit(float(weight))).alias("score"), F.lit(shard).cast("int").alias("shard"))

    scores = [score(*s) for s in shards]
    return F.least(*scores) if len(scores) > 1 else scores[0]


def assign(df: DataFrame, key: str, shards: Sequence[tuple[int, float]], grown: Sequence[tuple[int, float]] = ()) -> DataFrame:
    """Adds ``shard`` and, for further shards ``grown``, ``grown_shard``."""
    out = df.withColumn("_win", rendezvous(F.col(key), shards))
    if grown:
        out = out.withColumn("grown_shard", F.least(F.col("_win"), rendezvous(F.col(key), grown))["shard"])
    return out.withColumn("shard", F.col("_win")["shard"]).drop("_win")


def number_slots(df: DataFrame, key: str, tie: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard.

    Rows are numbered within buckets of a shard, and each bucket starts where the ones before it end, so no task
    holds a whole shard. The table of bucket counts has at most shards times buckets rows; it is what is broadcast.
    """
    put = df.withColumn("_bucket", F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int"))
    counts = put.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    within = Window.partitionBy("shard", "_bucket").orderBy(key, *tie)
    return (
        put.withColumn("_row", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), ["shard", "_bucket"])
        .withColumn("slot", (F.col("_from") + F.col("_row")).cast("long"))
        .drop("_bucket", "_row", "_from")
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 of equal weight, under the law ``key``."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    put = assign(docs, "doc_id", [(i, 1.0) for i in range(16)], [(16, 1.0)])
    return number_slots(put, "doc_id", ["text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
