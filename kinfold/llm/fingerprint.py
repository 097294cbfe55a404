"""SimHash fingerprints of documents and exact search within a Hamming radius.

Terms are shingles of five words; each occurrence of a term's 128-bit hash votes once on every bit, so a term weighs as
often as it occurs. Search cuts fingerprints into blocks: two within radius r of each other agree on all blocks but r at
least, so with b blocks, a table for every choice of b - r blocks finds them all by equality.

Defined results: a null text is an empty one; a text without words has the fingerprint 0; equal texts have equal
fingerprints; equal ids follow each other by text, a null id comes first; with one document, the next is itself; an
empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.common import load, slices, small_batches, text_buffer, tidied, written
from kinfold.llm.text import mix, shingles, words

BITS = 128
#: Largest Hamming distance that the search takes as near, and the blocks of a fingerprint.
RADIUS, BLOCKS = 3, 4


def fingerprints(texts: pa.Array) -> np.ndarray:
    """(texts, 16) bytes."""
    buf, offsets = text_buffer(texts)
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    for i, j in slices(offsets):
        h, doc, _ = shingles(words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
        if not len(h):
            continue
        both = np.empty((len(h), 2), np.uint64)
        both[:, 0] = h
        both[:, 1] = mix(h + np.uint64(0x632BE59BD9B4E019))
        votes = np.unpackbits(both.view(np.uint8), axis=1)
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        ones = np.add.reduceat(votes, first, axis=0, dtype=np.int32)
        total = np.diff(np.append(first, len(h)))
        out[i + doc[first]] = np.packbits(2 * ones > total[:, None], axis=1)
    return out


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def hexes(fp: np.ndarray) -> list[str]:
    text = fp.tobytes().hex()
    n = 2 * fp.shape[1]
    return [text[i : i + n] for i in range(0, len(text), n)]


def edited(own: str, following: str) -> str:
    """``own`` with its last quarter replaced by as much of the head of ``following``."""
    k = len(own) // 4
    return own[: len(own) - k] + following[:k]


def _compare(own: list[str], nxt: list[str], fp: np.ndarray, fp_next: np.ndarray) -> list[pa.Array]:
    texts = [edited(a, b) for a, b in zip(own, nxt)]
    fp_edited = fingerprints(pa.array(texts, pa.string()))
    like = lambda x: pa.array(1.0 - hamming(fp, x) / BITS, pa.float64())
    return [pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()), pa.array(hexes(fp_edited), pa.string()), like(fp_edited), like(fp_next)]


_COMPARED = ["edited_sha256", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = "part int, doc_id long, n_chars long, fingerprint string, edited_sha256 string, edited_fingerprint string, near_edited double, near_next double, head string, tail string"


def fingerprint_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of each row of ``docs`` (doc_id, text), and how it compares with its edited text and the next row.

    One range exchange brings neighbours together. What a partition's last row lacks, the first row of the next
    partition that has any, is joined in afterwards: one row from each partition.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    @tidied
    def run(batches):
        from pyspark import TaskContext

        part, held, head = TaskContext.get().partitionId(), None, None

        def out(ids, texts, nxt, fp, fp_next, heads, tails):
            n = len(ids)
            compared = _compare(texts, nxt, fp, fp_next) if nxt is not None else [pa.nulls(n, t) for t in (pa.string(), pa.string(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(hexes(fp), pa.string()), *compared, pa.array(heads, pa.string()), pa.array(tails, pa.string())],
                ["part", "doc_id", "n_chars", "fingerprint", *_COMPARED, "head", "tail"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts, fp = batch.column(0).to_pylist(), batch.column(1).to_pylist(), fingerprints(batch.column(1))
            first = held is None
            if held:
                ids, texts, fp = [held[0], *ids], [held[1], *texts], np.concatenate([held[2], fp])
            if first:
                head = texts[0]
            if len(ids) > 1:
                heads = [head if first and k == 0 else None for k in range(len(ids) - 1)]
                yield out(ids[:-1], texts[:-1], texts[1:], fp[:-1], fp[1:], heads, [None] * (len(ids) - 1))
                first = False
            held = (ids[-1], texts[-1], fp[-1:], head if first else None)
        if held:
            yield out([held[0]], [held[1]], None, held[2], None, [held[3]], [held[1]])

    rows = written(docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, _SCHEMA), "fingerprints")
    # One row for each partition: no larger than the job's list of tasks.
    parts = rows.filter("head IS NOT NULL").select("part")
    order = Window.orderBy("part")
    following = parts.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("next_part"))
    heads = rows.filter("head IS NOT NULL").select(F.col("part").alias("next_part"), F.col("head").alias("next_text"), F.col("fingerprint").alias("next_fp"))
    tails = rows.filter("tail IS NOT NULL").join(following, "part").join(heads, "next_part").select("doc_id", "n_chars", "fingerprint", "tail", "next_text", "next_fp")

    @tidied
    def finish(batches):
        for batch in batches:
            own, nxt = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            fps = [np.array([list(bytes.fromhex(x)) for x in batch.column(k).to_pylist()], np.uint8).reshape(-1, BITS // 8) for k in (2, 5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *_compare(own, nxt, *fps)], ["doc_id", "n_chars", "fingerprint", *_COMPARED])

    schema = "doc_id long, n_chars long, fingerprint string, edited_sha256 string, edited_fingerprint string, near_edited double, near_next double"
    return rows.filter("tail IS NULL").select("doc_id", "n_chars", "fingerprint", *_COMPARED).unionByName(tails.mapInArrow(finish, schema))


def _distance(a: str, b: str) -> Column:
    """Set bits of the exclusive or of two hex fingerprints."""
    word = lambda c, k: F.conv(F.substring(c, 8 * k + 1, 8), 16, 10).cast("bigint")
    total = F.lit(0)
    for k in range(BITS // 32):
        total = total + F.bit_count(word(a, k).bitwiseXOR(word(b, k)))
    return total


def near(queries: DataFrame, all_fingerprints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, fingerprint, distance) of every distinct query and distinct fingerprint at most ``radius`` bits apart.

    Both sides are distinct hex strings in a column ``fingerprint``. Each side has one row in each permuted table; a pair
    that agrees in several tables comes from the first alone, and distance is part of the join's condition.
    """
    if not 0 <= radius < blocks or (BITS // 4) % blocks:
        raise ValueError("radius must be below blocks, and blocks must divide the hex digits of a fingerprint")
    width = BITS // 4 // blocks
    chosen = list(combinations(range(blocks), blocks - radius))
    keys = lambda c: F.posexplode(F.array(*[F.concat(*[F.substring(c, width * i + 1, width) for i in t]) for t in chosen])).alias("t", "key")
    left = queries.select(F.col("fingerprint").alias("query")).distinct().select("query", keys("query"))
    right = all_fingerprints.select("fingerprint").distinct().select("fingerprint", keys("fingerprint"))
    agree = [F.substring("query", width * i + 1, width) == F.substring("fingerprint", width * i + 1, width) for i in range(blocks)]
    earlier = F.lit(False)
    for n, t in enumerate(chosen):
        all_agree = F.lit(True)
        for i in t:
            all_agree = all_agree & agree[i]
        earlier = earlier | (all_agree & (F.col("t") > n))
    pairs = left.join(right, ["t", "key"])
    return pairs.filter((_distance("query", "fingerprint") <= radius) & ~earlier).select("query", "fingerprint", _distance("query", "fingerprint").alias("distance"))


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns, and ``n_near``: for every 20th id, how many other documents lie within the radius (else null)."""
    rows = written(fingerprint_with_next(load(spark, sf_dir, "documents", "doc_id", "text")), "fingerprinted")
    counts = rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.max(F.pmod("doc_id", F.lit(20)) == 0).alias("asked"))
    pairs = near(counts.filter("asked"), counts)
    around = pairs.join(counts.select("fingerprint", "n"), "fingerprint").groupBy("query").agg((F.sum("n") - 1).alias("n_near"))
    asked = rows.filter("pmod(doc_id, 20) = 0").join(around, rows["fingerprint"] == around["query"]).drop("query")
    rest = rows.filter("doc_id IS NULL OR pmod(doc_id, 20) <> 0").withColumn("n_near", F.lit(None).cast("long"))
    return asked.unionByName(rest)
