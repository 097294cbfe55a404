"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.plans.tables import ROWS_A_TASK, discard, small_tasks, written

#: Steps before giving up; distances at least halve with each.
MOST_STEPS = 60
#: Rows from which a key is hot, unless so many would be: of a table of n rows, keys of more than n / MOST_HOT, which are fewer than MOST_HOT.
HOT, MOST_HOT = 1_000_000, 500_000


def _with_least(rows: DataFrame, key: str, least: DataFrame, total: int, hot: int) -> DataFrame:
    """``rows`` with ``m`` of their key, from ``least`` (key, m, n rows).

    The least neighbour of a hub is one row, but a join by the hub would bring all its rows to one task. So rows of hot keys
    meet a broadcast table of those keys, of at most ``MOST_HOT`` rows, where they are; each other key is a small part of all rows.
    """
    if total <= hot:
        return rows.join(least.select(key, "m"), key)
    limit = max(hot, total // MOST_HOT)
    least = written(least, "least")
    few = least.filter(F.col("n") > limit).select(key, "m")
    if few.isEmpty():
        return rows.join(least.select(key, "m"), key)
    others = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(least.filter(F.col("n") <= limit).select(key, "m"), key)
    return rows.join(F.broadcast(few), key).unionByName(others)


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst", hot: int = HOT, tasks: int = 1) -> DataFrame:
    """(node, component) of every node with an edge; a component is named by its least node. ``tasks``: into how many ``edges`` are dealt, at least.

    Each step is a partial aggregate and an equi-join, and ends in a written table; a count and a checksum come to the driver.
    Steps are dealt to tasks by the number of edges.
    """
    spark = edges.sparkSession
    with small_tasks(spark, tasks):
        edges = written(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u <> v").distinct(), "edges")
        n = edges.count()
    tasks = -(-2 * n // ROWS_A_TASK) or 1
    with small_tasks(spark, tasks):
        edges = _stars(edges, n, hot)
    roots = edges.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "v").groupBy("v").agg(F.min("u").alias("component")).select(F.col("v").alias("node"), "component")
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())


def _stars(edges: DataFrame, n: int, hot: int) -> DataFrame:
    """``edges`` (u, v), n of them, as stars around the least node of each component."""
    last = None
    count = F.count(F.lit(1)).alias("n")
    for _ in range(MOST_STEPS):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), count)
        large = _with_least(both.filter("v > u"), "u", least, 2 * n, hot).select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        if 2 * n > hot:
            large = written(large, "large")  # read three times where keys may be hot
        down = large.groupBy("v").agg(F.min("u").alias("m"), count)
        small = _with_least(large, "v", down, 2 * n, hot).select("m", F.explode(F.array("u", "v")).alias("w")).filter("m <> w")
        before, edges = edges, written(small.select(F.col("m").alias("u"), F.col("w").alias("v")).distinct(), "edges")
        discard(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last, n = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {MOST_STEPS} steps")
    return edges
