"""Centroid clustering by delta Lloyd rounds over integer vectors.

Assignments and global sums persist from round to round. A round compares a vector with the centroids that have changed
since the last one alone: one that hasn't is no nearer than the vector's owner was. Only a vector whose owner has moved
away, with no changed centroid as near as it was, is compared with all of them. The rows that went over to another owner
give signed transfers, ``+v`` to the new one and ``-v`` to the old one, which are added to the global sums; so a round's
aggregation is as large as its moves. All numbers are integers, so results don't depend on the order of the rows.

A round is one pass over the written table of the round before (vector, owner, distance), without a shuffle; the table
before that is deleted. What comes to the driver is a row for each cluster.

Defined results: vectors of another length, null ones, and those with a null, NaN or infinite component are left out;
repeated and null ids are rows of their own; ties go to the smaller centroid number; of equal ids the least vector comes
first where centroids start, null ids come last; fewer vectors than centroids make fewer centroids; an empty table gives
no rows. A component of more than ``MOST`` in size counts as one of ``MOST``, so that no distance leaves a long. Other
columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import load, tidied, written
from kinfold.plans.tables import discard

SIZE, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Largest component, and the largest for which products of doubles are exact.
MOST, EXACT = 1 << 27, 1 << 22
#: Vectors whose distances a task works out at once.
LOT = 1 << 13


def kept_vectors(embeddings: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors of ``size`` finite components as integers floor(scale * x)."""
    x = F.col("embedding").cast("array<double>")
    ok = (F.size(x) == size) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = F.transform(x, lambda e: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(e * F.lit(float(scale))))).cast("int"))
    return embeddings.select("vec_id", F.col("embedding")).filter(ok).select("vec_id", whole.alias("v"))


def first_centroids(vectors: DataFrame, clusters: int) -> list[list[int]]:
    """The vectors of the least hashes of their ids."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(order.alias("h"), "vec_id", "v").orderBy(F.col("h").asc_nulls_last(), "vec_id", "v").limit(clusters).collect()
    return [list(r["v"]) for r in rows]


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of integer vectors, exactly."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        a, b = v.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(1) for c in centroids], 1)


def nearest(v: np.ndarray, centroids: np.ndarray, changed: np.ndarray, owner: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances. ``owner`` and ``distance`` are those of the last round, when no centroid came before the owner in order of distance and number; so one that hasn't changed doesn't come before that place now."""
    owner, distance = owner.copy(), distance.copy()
    if not len(changed) or not len(v):
        return owner, distance
    d = distances(v, centroids[changed])
    best = d.argmin(1)
    least, number = d[np.arange(len(v)), best], changed[best]
    before = (least < distance) | ((least == distance) & (number <= owner))
    lost = ~before & np.isin(owner, changed)  # the owner went away, and nothing came as near: the others may be nearest
    owner[before], distance[before] = number[before], least[before]
    if lost.any():
        d = distances(v[lost], centroids)
        owner[lost], distance[lost] = d.argmin(1), d.min(1)
    return owner, distance


def _assign(state: DataFrame, centroids: Sequence[Sequence[int]], changed: Sequence[int]) -> DataFrame:
    """One pass: (vec_id, v, before, cluster, distance); ``before`` is the owner of the last round, -1 in the first."""
    points, which, names = np.array(centroids, np.int64), np.array(changed, np.int64), state.columns

    @tidied
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, LOT):
                part = batch.slice(at, LOT)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).astype(np.int64)
                owner, distance = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4))
                now, d = nearest(v, points, which, owner, distance)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(now, pa.int32()), pa.array(d)], names)

    return state.mapInArrow(run, state.schema)


def _transfers(state: DataFrame, size: int) -> dict[int, tuple[int, list[int]]]:
    """For each cluster, the signed number of rows that it won and the signed sum of their vectors."""
    sign = F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("s")), F.struct(F.col("before").alias("c"), F.lit(-1).alias("s")))).alias("to")
    moves = state.filter("cluster != before").select("v", sign).filter("to.c >= 0").select(F.col("to.c").alias("c"), F.col("to.s").alias("s"), "v")

    def total(i: int) -> Column:
        return F.sum((F.col("s") * F.col("v")[i]).cast("long"))

    rows = moves.groupBy("c").agg(F.sum("s").alias("n"), F.array(*[total(i) for i in range(size)]).alias("sums")).collect()
    return {r["c"]: (r["n"], list(r["sums"])) for r in rows}


def delta_lloyd(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, v, before, cluster, distance) of every row of ``vectors`` (vec_id, v) after ``rounds`` rounds, as a written table, and the centroids."""
    centroids = first_centroids(vectors, clusters)
    nobody, far = F.lit(-1), F.lit((1 << 63) - 1)
    state = vectors.select("vec_id", "v", nobody.alias("before"), nobody.alias("cluster"), far.alias("distance"))
    if not centroids:
        return state.filter(F.lit(False)), []
    size = len(centroids[0])
    count, sums = [0] * len(centroids), [[0] * size for _ in centroids]
    changed, old = list(range(len(centroids))), None
    for k in range(rounds + 1):
        state = written(_assign(state, centroids, changed), f"clusters-{k}")
        if old is not None:
            discard(old)
        old = state
        if k == rounds:
            break
        for c, (n, add) in _transfers(state, size).items():
            count[c] += n
            sums[c] = [a + b for a, b in zip(sums[c], add)]
        new = [[x // n for x in s] if n else c for c, n, s in zip(centroids, count, sums)]
        changed = [i for i, (a, b) in enumerate(zip(new, centroids)) if a != b]
        centroids = new
    return state, centroids


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of ``embeddings`` with their clusters, the clusters' and the whole inertia."""
    vectors = kept_vectors(load(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    state, centroids = delta_lloyd(vectors)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    # Totals are a row for each cluster, so they are worked out once and joined as a small table.
    totals = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()
    inertia = {r["cluster"]: int(r["n"]) for r in totals}
    rows = [(c, inertia[c], sum(inertia.values()), hashes[c]) for c in sorted(inertia)]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op11_sql() -> str:
    """The rounds one after the other, each over all vectors and centroids."""
    steps = [
        f"""kept AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {SIZE})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h NULLS LAST, vec_id, v) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, vec_id, v FROM kept ORDER BY h NULLS LAST, vec_id, v LIMIT {CLUSTERS}))",
    ]
    for k in range(ROUNDS + 1):
        steps.append(
            f"""a{k} AS (SELECT r, min(d).d AS distance, min(d).c AS c FROM (SELECT r, {{'d': CAST(list_sum(list_transform(list_zip(kept.v, c{k}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'c': c}} AS d
 FROM kept, c{k}) GROUP BY r)"""
        )
        if k < ROUNDS:
            steps.append(f"m{k} AS (SELECT c, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept JOIN a{k} USING (r)) GROUP BY c, i)")
            steps.append(f"g{k} AS (SELECT c, list(CAST(CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END AS BIGINT) ORDER BY i) AS v FROM m{k} GROUP BY c)")
            steps.append(f"c{k + 1} AS (SELECT c, coalesce(g{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN g{k} USING (c))")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256
FROM kept JOIN a{ROUNDS} USING (r) JOIN c{ROUNDS} USING (c)"""


OP11_SQL = _op11_sql()
