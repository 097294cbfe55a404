"""Benchmark decontamination by Wu-Manber search over words.

A pattern is a window of ten consecutive words of a benchmark item, or all words of a shorter one. For each pattern
length a shift table tells, for the block of words that ends at a position, how far the next possible end of a
pattern is; at shift 0, the bucket of the block's hash names the patterns that may end there, and their bytes are
compared with the document's.

The benchmark's tasks make its patterns, in packs of bounded size. As many packs as a bound allows are broadcast at once; a
larger benchmark takes several passes over the documents.

Defined results: a null or empty text has no words and is never hit; an item without words is never found; an item without
an id hits words, but is neither listed nor counted; equal windows of several items count for each; repeated documents get a
row each; a very long text is one slice of work; an empty benchmark contaminates nothing; other columns of the input are not
read, and kept by ``keep_clean``.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from kinfold.llm.common import load, packed, slices, small_batches, text_buffer, tidied, unpacked, written
from kinfold.llm.text import Words, mix, words

#: Words of a window.
WINDOW = 10
#: Bytes of benchmark text in a pack of patterns, and bytes of packs that are broadcast for one pass.
PACK_BYTES, PASS_BYTES = 1 << 20, 64 << 20
#: Words of a block, positions that one lane of the vectorised scan covers, and bits of the shift table: least, most.
BLOCK, LANE, TABLE_BITS = 2, 256, (12, 20)


class Patterns(NamedTuple):
    length: int
    block: int
    bits: int  # of the block hash
    shift: np.ndarray  # by block hash
    bucket: np.ndarray  # sorted block hashes at which patterns end
    first: np.ndarray  # of each bucket, in patterns; one more at the end
    hash: np.ndarray  # (patterns, length) of the words
    text: list[bytes]  # words joined by a space
    items: list[list[int]]


def _block_hash(h: np.ndarray, at: np.ndarray, block: int, bits: int) -> np.ndarray:
    key = h[at].copy()
    for j in range(1, block):
        key = mix(key + h[at - j] * np.uint64(0x9E3779B97F4A7C15 + 2 * j))
    return (key >> np.uint64(64 - bits)).astype(np.int64)


def compile_patterns(items: Iterable[tuple[int | None, str]], window: int = WINDOW) -> list[Patterns]:
    rows = list(items)
    w = words(*text_buffer(pa.array([t for _, t in rows], pa.string())))
    by_length: dict[int, dict[bytes, tuple[int, set[int]]]] = {}
    for k, (item, _) in enumerate(rows):
        a, b = int(w.first[k]), int(w.first[k + 1])
        n = min(window, b - a)
        for i in range(a, b - n + 1) if n else ():
            by_length.setdefault(n, {}).setdefault(_joined(w, i, i + n), (i, set()))[1].add(item)
    out = []
    for n, found in sorted(by_length.items()):
        block = min(BLOCK, n)
        at = np.array([i for i, _ in found.values()])
        bits = min(max(int(8 * len(at)).bit_length(), TABLE_BITS[0]), TABLE_BITS[1])
        shift = np.full(1 << bits, n - block + 1, np.uint8 if n < 256 else np.int32)
        for j in range(block - 1, n):
            np.minimum.at(shift, _block_hash(w.hash, at + j, block, bits), n - 1 - j)
        ends = _block_hash(w.hash, at + n - 1, block, bits)
        order = np.argsort(ends, kind="stable")
        bucket, first = np.unique(ends[order], return_index=True)
        found_rows = list(found.items())
        out.append(Patterns(n, block, bits, shift, bucket, np.append(first, len(order)), w.hash[at[order][:, None] + np.arange(n)], [found_rows[i][0] for i in order], [sorted(x for x in found_rows[i][1][1] if x is not None) for i in order]))
    return out


def _joined(w: Words, i: int, j: int) -> bytes:
    return b" ".join(w.low[w.start[x] : w.end[x]].tobytes() for x in range(i, j))


def search(w: Words, p: Patterns) -> Iterator[tuple[int, int]]:
    """(first word, pattern) of each occurrence. Lanes of positions are scanned together, each skipping by its own shifts."""
    count = np.diff(w.first)
    ends = np.maximum(0, count - p.length + 1)
    lanes = -(-ends // LANE)
    doc = np.repeat(np.arange(len(count)), lanes)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    pos = w.first[doc] + p.length - 1 + k * LANE
    stop = np.minimum(pos + LANE, w.first[doc + 1])
    stops = []
    while len(pos):
        s = p.shift[_block_hash(w.hash, pos, p.block, p.bits)].astype(np.int64)
        stops.append(pos[s == 0])
        pos = pos + np.maximum(s, 1)
        on = pos < stop
        pos, stop = pos[on], stop[on]
    if not stops:
        return
    at = np.concatenate(stops)
    key = _block_hash(w.hash, at, p.block, p.bits)
    b = np.searchsorted(p.bucket, key)
    n = p.first[b + 1] - p.first[b]
    pattern = np.repeat(p.first[b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    start = np.repeat(at, n) - p.length + 1
    same = np.ones(len(start), bool)
    for j in range(p.length):
        on = np.flatnonzero(same)
        same[on] = w.hash[start[on] + j] == p.hash[pattern[on], j]
    for i, x in zip(start[same].tolist(), pattern[same].tolist()):
        if _joined(w, i, i + p.length) == p.text[x]:
            yield i, x


def scan(texts: pa.Array, packs: Iterable[list[Patterns]], known: Iterable[tuple[list[int], list[int], list[int]]] | None = None) -> dict[str, list]:
    """Words, stretches of hit words (starts, ends) and found items of each text, with those ``known`` from earlier passes."""
    buf, offsets = text_buffer(texts)
    out: dict[str, list] = {"n_words": [], "starts": [], "ends": [], "item_ids": []}
    before = iter(known) if known is not None else None
    packs = list(packs)
    for i, j in slices(offsets):
        w = words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        edge, items = np.zeros(len(w.hash) + 1, np.int64), [set() for _ in range(i, j)]
        for k in range(j - i) if before is not None else ():
            starts, ends, ids = next(before)
            np.add.at(edge, np.asarray(starts, np.int64) + w.first[k], 1)
            np.add.at(edge, np.asarray(ends, np.int64) + w.first[k], -1)
            items[k].update(ids)
        for p in (p for pack in packs for p in pack):
            for a, x in search(w, p):
                edge[a] += 1
                edge[a + p.length] -= 1
                items[int(w.doc[a])].update(p.items[x])
        # No stretch goes on into the next text.
        hit = np.append(np.cumsum(edge)[:-1] > 0, False)
        first = np.zeros(len(hit), bool)
        first[w.first[:-1]] = True
        begin = np.flatnonzero(hit & (np.append(True, ~hit[:-1]) | first))
        end = np.flatnonzero(hit & np.append(~hit[1:] | first[1:], True)) + 1
        doc = w.doc[begin]
        at = np.searchsorted(doc, np.arange(j - i + 1)).tolist()
        begin, end = begin - w.first[doc], end - w.first[doc]
        out["n_words"] += np.diff(w.first).tolist()
        out["starts"] += [begin[a:b].tolist() for a, b in zip(at, at[1:])]
        out["ends"] += [end[a:b].tolist() for a, b in zip(at, at[1:])]
        out["item_ids"] += [sorted(x) for x in items]
    return out


def _packs(benchmark: DataFrame, window: int, pack_bytes: int) -> DataFrame:
    """(pack): patterns of the items with a text, made in the benchmark's own tasks."""

    @tidied
    def run(batches):
        def packed(items):
            found = compile_patterns(items, window)
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)] if found else [], pa.binary())], ["pack"])

        items, size = [], 0
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                items.append((item, text))
                size += len(text)
                if size > pack_bytes:
                    yield packed(items)
                    items, size = [], 0
        if items:
            yield packed(items)

    return benchmark.select("item_id", "text").filter("text IS NOT NULL").mapInArrow(run, "pack binary")


_SPANS = "n_words long, starts array<long>, ends array<long>, item_ids array<long>"
_TYPES = [pa.int64(), *[pa.list_(pa.int64())] * 3]


def _passes(packs: DataFrame, most: int) -> Iterator:
    """Broadcasts of a name and a list of packs, each of at most ``most`` bytes or of one pack. At most one is held at a time."""
    lot, size = [], 0
    for r in packs.toLocalIterator():
        if lot and size + len(r["pack"]) > most:
            yield packs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, lot))
            lot, size = [], 0
        lot.append(bytes(r["pack"]))
        size += len(r["pack"])
    if lot:
        yield packs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, lot))


_loaded: dict[str, list[list[Patterns]]] = {}


def _unpacked(sent) -> list[list[Patterns]]:
    """The patterns of a broadcast; a worker keeps those of one."""
    name, lot = sent.value
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = [pickle.loads(p) for p in lot]
    return _loaded[name]


def spans(rows: DataFrame, benchmark: DataFrame, window: int = WINDOW, pack_bytes: int = PACK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``rows`` (row, text) with n_words, starts and ends of stretches of hit words, and item_ids; without text."""
    small_batches(rows.sparkSession)
    rows = rows.select("row", "text")
    row = rows.schema["row"]
    packs = written(_packs(benchmark, window, pack_bytes), "patterns")
    state, number = rows, 0

    def one_pass(df: DataFrame, sent, last: bool) -> DataFrame:
        first = "n_words" not in df.columns

        @tidied
        def run(batches):
            for batch in batches:
                known = None if first else zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)))
                found = scan(batch.column(1), _unpacked(sent) if sent is not None else [], known)
                arrays = [pa.array(v, t) for v, t in zip(found.values(), _TYPES)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: 1 if last else 2], *arrays], [*(["row"] if last else ["row", "text"]), *found])

        schema = StructType([row, *([] if last else [StructField("text", StringType())]), *_parse_datatype_string(_SPANS).fields])
        return df.mapInArrow(run, schema)

    sent = None
    for following in _passes(packs, pass_bytes):
        if sent is not None:
            state = written(one_pass(state, sent, False), "pass")
        sent = following
    return one_pass(state, sent, True)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **bounds: int) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids, starts, ends, contaminated of each row of ``docs`` (doc_id, text) against ``benchmark`` (item_id, text)."""
    found = spans(docs.select(F.col("doc_id").alias("row"), "text"), benchmark, window, **bounds)
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select(F.col("row").alias("doc_id"), "n_words", n_hit.alias("n_hit"), "item_ids", "starts", "ends", (F.size("starts") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **bounds: int) -> DataFrame:
    """``docs``, its columns as they are, without the rows that have a benchmark window."""
    found = spans(docs.select(packed(docs).alias("row"), docs["text"].alias("text")), benchmark, window, **bounds)
    return unpacked(found.filter(F.size("starts") == 0), docs)


def items_digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "benchmark", "item_id", "text"))
    as_text = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(as_text.cast("binary"), 256).alias("items_sha256"), "contaminated")


#: The same rows in DuckDB.
OP10_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL),
bp AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS pat
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM bw WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM bp),
win AS (
  SELECT rid, n, i, array_to_string(ws[i : i + n - 1], ' ') AS pat
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, ns WHERE len(ws) >= n)),
hit AS (SELECT w.rid, w.i, w.n, b.item_id FROM win w JOIN bp b ON w.pat = b.pat AND w.n = b.n),
words_hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
found AS (
  SELECT rid, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words_hit h USING (rid) LEFT JOIN found f USING (rid)
"""
