"""Coarsening of large communities until one task can divide them.

Nodes join clusters by local moves, as in a community search, but all at once: in a round every node finds the neighbouring
cluster of the greatest gain ``links - gamma * weight * (cluster's weight)`` by an aggregate over its links, and of those
that gain the half that the round's hash picks goes over; a single node joins another single one only if that has the lesser
hash, so two never change places. After some rounds the clusters become the nodes of a smaller graph: weights are summed,
links are summed, those inside a cluster become loops. ``gamma`` falls from time to time, so that dense places are drawn
together first, and what a coarse node holds belongs together at any resolution at which a community as a whole is divided.

Communities are told apart by ``path`` and coarsened side by side; each until it has at most the given numbers of nodes and
links. Every round is two equi-joins and aggregates with map-side combination; no node or community is one task's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.plans.tables import discard, written

#: Rounds of moves before clusters become nodes; times that they do.
ROUNDS, MOST_LEVELS = 8, 60
#: What the mean density of a link is divided by at first, so that clusters are some ten nodes, whose links tell more than a single one; and gamma each time.
FIRST, STEP = 32, 4
EPS = 1e-12


def _hash(*columns: str, salt: int) -> F.Column:
    return F.xxhash64(*columns, F.lit(salt))


def _moved(nodes: DataFrame, links: DataFrame, gammas: DataFrame, salt: int) -> DataFrame:
    """``nodes`` (path, node, weight, c) after one round."""
    ends = links.filter("a <> b")
    both = ends.select("path", F.col("a").alias("node"), F.col("b").alias("v"), "w").unionByName(ends.select("path", F.col("b").alias("node"), F.col("a").alias("v"), "w"))
    # A cluster's size comes along with its nodes, so the links needn't meet it.
    sizes = nodes.groupBy("path", "c").agg(F.sum("weight").alias("whole"), F.count(F.lit(1)).alias("n"))
    sized = nodes.join(sizes, ["path", "c"]).select("path", "node", "weight", "c", "whole", "n")
    there = sized.select("path", F.col("node").alias("v"), F.col("c").alias("to"), "whole", "n")
    own = sized.select("path", "node", F.col("c").alias("to"), F.lit(0.0).alias("w"), "whole", "n")
    reach = both.join(there, ["path", "v"]).select("path", "node", "to", "w", "whole", "n").unionByName(own)
    reach = reach.groupBy("path", "node", "to").agg(F.sum("w").alias("k"), F.first("whole").alias("whole"), F.first("n").alias("n"))
    seen = reach.join(sized.select("path", "node", "weight", "c", F.col("n").alias("mine")), ["path", "node"]).join(gammas, "path")
    stays = F.col("to") == F.col("c")
    gain = F.col("k") - F.col("gamma") * F.col("weight") * (F.col("whole") - F.when(stays, F.col("weight")).otherwise(0.0))
    allowed = stays | ~((F.col("n") == 1) & (F.col("mine") == 1)) | (_hash("to", salt=0) < _hash("c", salt=0))
    best = F.max(F.struct("gain", "turn", "to")).alias("best")
    rated = seen.filter(allowed).select("path", "node", "weight", "c", gain.alias("gain"), _hash("to", "node", salt=salt).alias("turn"), "to", stays.alias("stays"))
    chosen = rated.groupBy("path", "node").agg(F.first("weight").alias("weight"), F.first("c").alias("c"), best, F.max(F.when(F.col("stays"), F.col("gain"))).alias("here"))
    goes = (F.col("best.gain") > F.col("here") + EPS) & (F.pmod(_hash("node", salt=salt), F.lit(2)) == 0)
    return chosen.select("path", "node", "weight", F.when(goes, F.col("best.to")).otherwise(F.col("c")).alias("c"))


def _contracted(links: DataFrame, names: DataFrame) -> DataFrame:
    """``links`` between the clusters' names."""
    a, b = names.select("path", F.col("node").alias("a"), F.col("name").alias("x")), names.select("path", F.col("node").alias("b"), F.col("name").alias("y"))
    on = links.join(a, ["path", "a"]).join(b, ["path", "b"])
    return on.groupBy("path", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w"))


def coarsen(members: DataFrame, links: DataFrame, most_nodes: int, most_links: int, strength: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(path, gene, node), (path, node, weight) and (path, a, b, w) of each community's coarse graph, loops with ``a`` = ``b``; all are written tables.

    ``members`` has (path, gene), ``links`` (path, src, dst, w) with both ends in the community. A node weighs as many genes as it holds, or
    their ``strength``, the weight of their links.
    """
    links = written(links.groupBy("path", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").alias("w")), "coarse-links")
    place = written(members.select("path", "gene", F.col("gene").alias("node")), "coarse-places")
    nodes = place.select("path", "node", F.lit(1.0).alias("weight"))
    if strength:
        each = links.select("path", F.explode(F.array("a", "b")).alias("node"), "w").groupBy("path", "node").agg(F.sum("w").alias("weight"))
        nodes = place.select("path", "node").join(each, ["path", "node"], "left").fillna(0.0, ["weight"])
    nodes = written(nodes, "coarse-nodes")
    gammas: DataFrame | None = None
    for level in range(MOST_LEVELS):
        n_links = links.filter("a <> b").groupBy("path").agg(F.count(F.lit(1)).alias("m"))
        # Written, so that Spark knows how small it is; joined by path alone, it must not draw a community's links to one task.
        large = nodes.groupBy("path").agg(F.count(F.lit(1)).alias("n")).join(n_links, "path", "left").filter((F.col("n") > most_nodes) | (F.col("m") > most_links)).select("path")
        large = written(large, "coarse-large")
        a, b = nodes.select("path", F.col("node").alias("a"), F.col("weight").alias("wa")), nodes.select("path", F.col("node").alias("b"), F.col("weight").alias("wb"))
        mean = links.filter("a <> b").join(large, "path", "left_semi").join(a, ["path", "a"]).join(b, ["path", "b"])
        mean = mean.groupBy("path").agg((F.sum("w") / F.sum(F.col("wa") * F.col("wb")) / FIRST).alias("gamma"))
        if gammas is not None:
            mean = large.join(gammas, "path").select("path", (F.col("gamma") / STEP).alias("gamma"))
        spent, gammas = gammas, written(mean, "coarse-gammas")
        discard(large, *([] if spent is None else [spent]))
        if gammas.isEmpty():
            break
        at = written(nodes.join(gammas.select("path"), "path", "left_semi").withColumn("c", F.col("node")), "coarse-labels")
        some = links.join(gammas.select("path"), "path", "left_semi")
        for r in range(ROUNDS):
            old, at = at, written(_moved(at, some, gammas, level * ROUNDS + r + 1), "coarse-labels")
            discard(old)
        least = at.groupBy("path", "c").agg(F.min("node").alias("name"))
        renamed = at.join(least, ["path", "c"]).select("path", "node", "name")
        # Communities that fit already keep their nodes.
        names = written(nodes.select("path", "node").join(renamed, ["path", "node"], "left").select("path", "node", F.coalesce("name", "node").alias("name")), "coarse-names")
        stale = [place, nodes, links, at]
        place = written(place.join(names, ["path", "node"]).select("path", "gene", F.col("name").alias("node")), "coarse-places")
        nodes = written(nodes.join(names, ["path", "node"]).groupBy("path", F.col("name").alias("node")).agg(F.sum("weight").alias("weight")), "coarse-nodes")
        links = written(_contracted(links, names), "coarse-links")
        discard(*stale, names)
    else:
        raise RuntimeError(f"communities did not fit after {MOST_LEVELS} levels")
    return place, nodes, links


def settle(nodes: DataFrame, links: DataFrame, gammas: DataFrame, strength: bool, rounds: int) -> DataFrame:
    """``nodes`` (path, node, c) after rounds of moves between the clusters that there are. ``links`` (path, src, dst, w), ``gammas`` (path, gamma); a written table."""
    ends = links.groupBy("path", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").alias("w"))
    ends = written(ends.join(gammas.select("path"), "path", "left_semi"), "settle-links")
    at = nodes.select("path", "node", F.lit(1.0).alias("weight"), "c")
    if strength:
        each = ends.select("path", F.explode(F.array("a", "b")).alias("node"), "w").groupBy("path", "node").agg(F.sum("w").alias("weight"))
        at = nodes.join(each, ["path", "node"], "left").fillna(0.0, ["weight"]).select("path", "node", "weight", "c")
    for r in range(rounds):
        old, at = at, written(_moved(at, ends, gammas, -1 - r), "settled")
        if r:
            discard(old)
    discard(ends)
    return at
