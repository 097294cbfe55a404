"""Quality classifier: a sparse ensemble of rules over text statistics, scored by Spark columns.

Statistics of each text are counted in one pass. On a bounded sample of labelled documents, small trees are boosted; each
path from a root to a node is a rule, a conjunction of comparisons; a lasso logistic fit weighs the rules, and those of
weight 0 go. What is left is compiled into one Spark column.

Defined results: a null text is an empty one, whose statistics are 0; labels that are null, or of documents that aren't
there, teach nothing; of several labels of a document the largest counts; without labels of both classes every score is
the share of label 1 (0.5 without labels); repeated rows get a row each; an empty table gives no rows; other columns of
the input are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import crc_mod5, load, slices, small_batches, text_buffer, tidied, written
from kinfold.llm.text import shingles, span_hash, words

#: Most labelled documents that are learnt from: those of the lowest id hashes.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST_ROWS = 30, 3, 32, 0.3, 20
#: Lasso penalty of a rule's weight, as a share of the mean loss; steps of the fit; weights below this go.
PENALTY, STEPS, LEAST_WEIGHT = 1e-3, 400, 1e-3
#: predicted is 1 from this score on.
CUT = 0.3

STATISTICS = (
    "log_bytes log_words word_bytes upper digits symbols bars bangs stops non_ascii spaces lines line_words repeated_words"
    " top_word same_as_before repeated_shingles repeated_lines longest_word short_words controls"
).split()
_GROUPS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "symbols": b"#$%&*@^~<>{}[]\\/_=+", "bars": b"|", "bangs": b"!?",
    "stops": b".,;:", "non_ascii": bytes(range(128, 256)), "spaces": b" \t\n\r\x0b\x0c", "controls": bytes([*range(9), *range(14, 32), 127]),
}


def _share_repeated(key: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text's keys, the share beyond the first of their kind, and the share of the commonest."""
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(k)))
    total = np.maximum(np.bincount(doc, minlength=n), 1)
    top = np.zeros(n)
    np.maximum.at(top, d[first], count)
    return (np.bincount(doc, minlength=n) - np.bincount(d[first], minlength=n)) / total, top / total


def statistics(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n, size = len(offsets) - 1, np.diff(offsets)
    at_least = np.maximum(size, 1)
    w = words(buf, offsets)
    count, length = np.diff(w.first), w.end - w.start
    out = {"log_bytes": np.log1p(size), "log_words": np.log1p(count)}
    out["word_bytes"] = np.bincount(w.doc, length, n) / np.maximum(count, 1)
    for name, group in _GROUPS.items():
        has = np.zeros(256, bool)
        has[list(group)] = True
        sums = np.append(0, np.cumsum(has[buf], dtype=np.int64))
        out[name] = (sums[offsets[1:]] - sums[offsets[:-1]]) / at_least
    # Two-byte capitals count as upper case as well: À to Þ, whose lead byte is C3.
    if len(buf) > 1:
        caps = np.append((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E), False)
        sums = np.append(0, np.cumsum(caps, dtype=np.int64))
        out["upper"] = out["upper"] + 2 * (sums[offsets[1:]] - sums[offsets[:-1]]) / at_least
    breaks = np.flatnonzero(buf == 10)
    starts = np.unique(np.concatenate([offsets[:-1][size > 0], breaks + 1]))
    starts = starts[starts < len(buf)]
    ends = np.append(starts[1:], len(buf)) if len(starts) else starts
    line_doc = np.searchsorted(offsets, starts, "right") - 1
    lines = np.bincount(line_doc, minlength=n)
    out["lines"], out["line_words"] = np.log1p(lines), count / np.maximum(lines, 1)
    line_hash = span_hash(buf, starts, ends)
    out["repeated_lines"] = _share_repeated(line_hash, line_doc, n)[0]
    out["repeated_words"], out["top_word"] = _share_repeated(w.hash, w.doc, n)
    before = np.zeros(len(w.hash), bool)
    before[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    out["same_as_before"] = np.bincount(w.doc, before, n) / np.maximum(count, 1)
    h, doc, _ = shingles(w)
    out["repeated_shingles"] = _share_repeated(h, doc, n)[0]
    longest = np.zeros(n)
    np.maximum.at(longest, w.doc, length)
    out["longest_word"] = np.log1p(longest)
    out["short_words"] = np.bincount(w.doc, length <= 2, n) / np.maximum(count, 1)
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)

    @tidied
    def run(batches):
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            for i, j in slices(offsets):
                got = statistics(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *[pa.array(got[s].astype(float)) for s in STATISTICS]], ["doc_id", *STATISTICS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


#: (statistic, whether above the threshold, threshold) of each part of a conjunction.
Rule = tuple[tuple[int, bool, float], ...]


class Ensemble(NamedTuple):
    rules: list[Rule]
    weights: list[float]
    base: float


def _grow(bins: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, path: Rule, out: list[Rule], value: np.ndarray) -> None:
    """One tree of a boosting step: its nodes' paths go to ``out``, its leaves' steps to ``value``."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, -1, -1)
    if len(path) < DEPTH and len(rows) >= 2 * LEAST_ROWS:
        for f in range(bins.shape[1]):
            if not len(edges[f]):
                continue
            k = len(edges[f]) + 1
            gs, hs, ns = (np.cumsum(np.bincount(bins[rows, f], x, k))[:-1] for x in (grad[rows], hess[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < LEAST_ROWS) | (len(rows) - ns < LEAST_ROWS)] = -1
            if (b := int(gain.argmax())) >= 0 and gain[b] > best[0]:
                best = (float(gain[b]), f, b)
    if best[1] < 0:
        value[rows] = -RATE * g / (h + 1)
        return
    _, f, b = best
    right = bins[rows, f] > b
    for above, part in ((False, rows[~right]), (True, rows[right])):
        step = (*path, (f, above, float(edges[f][b])))
        out.append(step)
        _grow(bins, edges, grad, hess, part, step, out, value)


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    on = np.ones(len(x), bool)
    for f, above, t in rule:
        on &= (x[:, f] > t) == above
    return on


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Rules and weights from statistics (rows, statistics) and labels 0 or 1."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        return Ensemble([], [], float("inf") if share == 1 else float("-inf") if share == 0 else 0.0)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] for f, e in enumerate(edges)]
    bins = np.column_stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)])
    raw, found = np.full(len(y), np.log(share / (1 - share))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        value = np.zeros(len(y))
        _grow(bins, edges, p - y, p * (1 - p), np.arange(len(y)), (), found, value)
        raw += value
    rules, columns, seen = [], [], set()
    for r in found:
        on = covers(r, x)
        key = np.packbits(on).tobytes()
        if key not in seen and np.packbits(~on).tobytes() not in seen and 0 < on.mean() < 1:
            seen.add(key)
            rules.append(r)
            columns.append(on)
    if not rules:
        return Ensemble([], [], float(np.log(share / (1 - share))))
    a = np.column_stack(columns).astype(np.float32)
    mean, sd = a.mean(axis=0), np.maximum(a.std(axis=0), 0.05)
    z = (a - mean) / sd
    # Accelerated proximal gradient for the mean logistic loss with a lasso penalty; the base is free.
    step = 4.0 / max(1e-9, float(np.linalg.eigvalsh((z.T @ z) / len(y))[-1]) + 1)
    w = v = np.zeros(z.shape[1])
    b = vb = float(np.log(share / (1 - share)))
    t = 1.0
    for _ in range(STEPS):
        err = 1 / (1 + np.exp(-(z @ v.astype(np.float32) + vb))) - y
        u = v - step * (z.T @ err.astype(np.float32)) / len(y)
        new, nb = np.sign(u) * np.maximum(np.abs(u) - step * PENALTY, 0), vb - step * float(err.mean())
        tn = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / tn * (new - w), nb + (t - 1) / tn * (nb - b)
        w, b, t = new, nb, tn
    keep = np.abs(w) >= LEAST_WEIGHT
    scaled = w / sd
    return Ensemble([r for r, k in zip(rules, keep) if k], scaled[keep].tolist(), float(b - (scaled[keep] * mean[keep]).sum()))


def compiled(e: Ensemble) -> Column:
    """The score as a Spark column over the statistics."""
    if e.base in (float("inf"), float("-inf")):
        return F.lit(1.0 if e.base > 0 else 0.0)
    total = F.lit(e.base)
    for rule, weight in zip(e.rules, e.weights):
        on = None
        for f, above, t in rule:
            part = (F.col(STATISTICS[f]) > t) if above else (F.col(STATISTICS[f]) <= t)
            on = part if on is None else on & part
        total = total + F.when(on, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def learn(stats: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Ensemble:
    """``labels`` has (doc_id, label); at most ``most`` labelled rows of statistics come to the driver."""
    known = labels.dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = stats.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    x = np.column_stack([rows.column(s).to_numpy() for s in STATISTICS]) if rows.num_rows else np.zeros((0, len(STATISTICS)))
    return fit(x, rows.column("label").to_numpy().astype(float))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score and the statistics of each row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, label)."""
    stats = written(with_statistics(docs), "statistics")
    return stats.withColumn("score", compiled(learn(stats, labels)))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels", "doc_id", "quality")
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter(crc_mod5("doc_id") != 0)
    out = quality(load(spark, sf_dir, "documents", "doc_id", "text"), labels)
    held = F.coalesce(crc_mod5("doc_id") == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
