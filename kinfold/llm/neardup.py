"""Near-duplicate documents by BagMinHash signatures of word-shingle multisets.

A document is the multiset of its shingles of five words, a shingle weighing as often as it occurs. Every shingle has
Poisson processes over its weight axis, cut into the dyadic ranges (0, 1], (1, 2], (2, 4], ...; a point has a time, a
weight level in its range and a signature component, and counts if the level is within the shingle's weight. The earliest
point of each component is the signature: two documents agree on a component with the probability of their weighted
Jaccard similarity. A document's points are drawn only up to a time by which its components are very likely full, and
later for the few that are not, so a signature costs about n + m log m points.

Bands of components bring candidates together; each candidate is compared with its bucket's leader by exact multiset
overlap. In buckets where some member doesn't match the leader, all members that share enough weight to be a pair, and that
links don't join yet, are compared; one of more than ``PART`` in parts first, after which one member of each joined set meets
the others', beyond ``MOST`` by the further bands in which they agree. Members of a bucket that are in different sets then are
compared with each other, all of them, in cells of a bounded number; so a bucket loses no link, whatever its size. Documents
that verified links join, directly or over others, are one class.

Defined results: documents with equal multisets are one class without further comparison; texts without words (also null)
are one class only with equal texts; a class's id is its least doc_id (null only if all are null); of equal least ids, the
least content decides; repeated rows get a row each; an empty table gives no rows; a very long text is one slice of work;
other columns of the input, whatever their names, are kept by ``keep_one`` and not read otherwise. Contents are told apart by
128-bit hashes and their numbers of shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from kinfold.llm.common import load, packed, slices, small_batches, text_buffer, tidied, unpacked, written
from kinfold.llm.graph import components
from kinfold.llm.text import common_elements, content_ids, mix, shingles, words

THRESHOLD = 0.8
#: Signature components, a power of two; BANDS * ROWS of them make band keys. At 0.8, a pair shares a band with probability 0.99995.
COMPONENTS, BANDS, ROWS = 128, 25, 5
#: A very large bucket is led in this many parts, and the parts' leaders by one of them.
SALTS = 8
#: Pairs of one content that are compared in one lot; members of a part of an open bucket; members that meet at once.
LOT, PART, MOST = 256, 1024, 2048
_U = np.uint64
_STEP, _SEED = _U(0xD1342543DE82EF95), _U(0x2545F4914F6CDD1D)


def multisets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Shingle hash, text and count of each distinct shingle of each text, and a 128-bit id of each text's whole multiset."""
    w = words(buf, offsets)
    h, doc, _ = shingles(w)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h)))
    h, doc = h[at], doc[at]
    pairs = np.column_stack([h, count.astype(_U)]).reshape(-1)
    ends, off = np.searchsorted(doc, np.arange(len(offsets))).tolist(), offsets.tolist()
    ids = [(pairs[2 * a : 2 * b], b"bag") if b > a else (w.low[x:y], b"text") for a, b, x, y in zip(ends, ends[1:], off, off[1:])]  # texts without words: of their bytes
    return h, doc, count, content_ids(ids)


def signatures(h: np.ndarray, doc: np.ndarray, count: np.ndarray, n_docs: int, m: int = COMPONENTS) -> np.ndarray:
    """(n_docs, m) hashes; rows of documents without shingles are 0."""
    weight = np.bincount(doc, count, n_docs)
    # Processes: one for each shingle and dyadic range that its weight reaches.
    bits = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)
    el = np.repeat(np.arange(len(h)), bits + 1)
    level = np.arange(len(el)) - np.repeat(np.cumsum(bits + 1) - bits - 1, bits + 1)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    span = np.maximum(low, 1)
    seed, pdoc, pcount = mix(h[el] + _SEED * (level + 1).astype(_U)), doc[el], count[el]
    best = np.full(n_docs * m, np.inf)
    todo, reach = np.flatnonzero(weight > 0), np.log(m) + 5.0
    while len(todo):
        on = np.zeros(n_docs, bool)
        on[todo] = True
        limit = reach / np.maximum(weight, 1)
        # Documents of few shingles need many points of each: several are drawn at once.
        chunk = 1 << np.floor(np.log2(np.clip(m * reach / np.maximum(weight, 1), 1, 256))).astype(int)
        for k in np.unique(chunk[todo]).tolist():
            i = np.flatnonzero(on[pdoc] & (chunk[pdoc] == k))
            t, drawn = np.zeros(len(i)), 0
            while len(i):
                rate = (m * span[i])[:, None]
                r = mix(seed[i][:, None] + _STEP * np.arange(drawn + 1, drawn + k + 1).astype(_U))
                wait = -np.log(((r >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
                wait[:, 0] += t
                at = np.cumsum(wait, axis=1)
                r = mix(r)
                comp = (r & _U(m - 1)).astype(np.int64)
                y = low[i][:, None] + 1 + ((r >> _U(32)).astype(np.int64) * span[i][:, None] >> 32)
                ok = (at <= limit[pdoc[i]][:, None]) & (y <= pcount[i][:, None])
                np.minimum.at(best, (pdoc[i][:, None] * m + comp)[ok], at[ok])
                t, drawn = at[:, -1], drawn + k
                go = t <= limit[pdoc[i]]
                i, t = i[go], t[go]
        todo = todo[np.isinf(best.reshape(n_docs, m)[todo]).any(axis=1)]
        reach *= 2
    out = mix(np.where(np.isinf(best), 0.0, best).view(_U)).reshape(n_docs, m)
    out[weight == 0] = 0
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    key = np.broadcast_to(mix(np.arange(1, bands + 1).astype(_U)), (len(sig), bands)).copy()
    for r in range(rows):
        key = mix(key ^ sig[:, r : bands * rows : rows])
    return key


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, cid, band keys (empty for a text without words)."""

    @tidied
    def run(batches):
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            for i, j in slices(offsets):
                h, doc, count, content = multisets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                keys = band_keys(signatures(h, doc, count, j - i)).view(np.int64)
                has = np.zeros(j - i, bool)
                has[doc] = True
                ends = np.cumsum(np.where(has, BANDS, 0), dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(keys[has].ravel()))
                size = pa.array(np.bincount(doc, count, j - i).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), content, size, lists], ["doc_id", "content", "size", "bands"])

    return docs.mapInArrow(run, "doc_id long, content binary, size long, bands array<long>")


def with_content(docs: DataFrame) -> DataFrame:
    """(row, doc_id, content): rows of ``docs`` as they are in one column, whatever their columns' names, with the id of each one's multiset."""
    rows = docs.select(packed(docs).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))

    @tidied
    def run(batches):
        for batch in batches:
            buf, offsets = text_buffer(batch.column(2))
            ids = [multisets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[3] for i, j in slices(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.concat_arrays(ids) if ids else pa.array([], pa.binary())], ["row", "doc_id", "content"])

    schema = StructType([rows.schema["row"], rows.schema["doc_id"], StructField("content", BinaryType())])
    return rows.mapInArrow(run, schema)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets (sorted hashes, counts)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum())
    whole = int(a[1].sum()) + int(b[1].sum()) - low
    return low / whole if whole else 0.0


def _pack(h: np.ndarray, count: np.ndarray) -> bytes:
    return h.tobytes() + count.astype(np.uint32).tobytes()


def _unpack(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(x) // 12
    return np.frombuffer(x, _U, n), np.frombuffer(x, np.uint32, n, 8 * n)


def _contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, bag, size) of the wanted contents; ``wanted`` has (cid, content, doc_id), one document of each."""
    ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
    some = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")

    @tidied
    def run(batches):
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            for i, j in slices(offsets):
                h, doc, count, content = multisets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at = np.searchsorted(doc, np.arange(j - i + 1))
                packed = [_pack(h[at[k] : at[k + 1]], count[at[k] : at[k + 1]]) for k in range(j - i)]
                size = pa.array(np.bincount(doc, count, j - i).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), content, pa.array(packed, pa.binary()), size], ["_doc", "_content", "bag", "size"])

    bags = some.select("doc_id", "text").mapInArrow(run, "_doc long, _content binary, bag binary, size long")
    kept = bags.join(wanted, (F.col("content") == F.col("_content")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    return kept.groupBy("cid").agg(F.first("bag").alias("bag"), F.first("size").alias("size"))  # rows repeated with one id


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, content) of each row; (cid, content, doc_id, n) of each content, with a number, its least doc_id and its rows; and (cid, root) of each content that shares its class with another."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(_signed(docs), "signed")
    one = signed.groupBy("content", "size").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    one = written(one.withColumn("cid", F.monotonically_increasing_id()), "contents")
    bands = one.select("cid", F.explode("bands").alias("key"))
    bands = bands.select("key", "cid", F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int").alias("salt"))
    # A bucket's leader is its least content. A bucket is led in parts, so that none is one task's work; leaders of parts follow.
    part = Window.partitionBy("key", "salt")
    led = bands.withColumn("leader", F.min("cid").over(part))
    tops = led.filter("cid = leader").withColumn("leader", F.min("cid").over(Window.partitionBy("key")))
    links = written(led.select("key", "cid", "leader").filter("cid <> leader").unionByName(tops.select("key", "cid", "leader").filter("cid <> leader")), "candidates")
    pairs = links.select("cid", "leader").distinct()
    wanted = pairs.select(F.explode(F.array("cid", "leader")).alias("cid")).distinct().join(one.select("cid", "content", "doc_id"), "cid")
    bags = written(_contents(docs, wanted), "bags")
    verdict = written(_compared(pairs, bags, "leader"), "verdicts")

    # Buckets in which some member does not match its leader: there, all members meet.
    failed = links.join(verdict.filter(F.col("like") < threshold).select(F.col("a").alias("cid"), F.col("b").alias("leader")), ["cid", "leader"])
    linked = links.join(verdict.filter(F.col("like") >= threshold).select(F.col("a").alias("cid"), F.col("b").alias("leader")), ["cid", "leader"])
    members = links.select("key", F.explode(F.array("cid", "leader")).alias("cid")).distinct()
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("s")).filter("n > 2")
    # Buckets of the same members are one: told apart by key, so that members meet one join by it, with their bucket's size.
    open_keys = failed.select("key").distinct().join(sizes, "key").groupBy("s", "n").agg(F.min("key").alias("key")).select("key", "n")
    # A member that matches its leader has it as its root; of such, one suffices where no other links are looked for.
    rooted = linked.groupBy("key", "cid").agg(F.min("leader").alias("root"))
    open_members = written(members.join(open_keys, "key").join(rooted, ["key", "cid"], "left"), "open")
    more = _meeting(open_members.select("key", "cid", "root", "n"), bands, bags, threshold)
    good = verdict.filter(F.col("like") >= threshold).select("a", "b").unionByName(more)
    return signed.select("doc_id", "content", "size"), one.drop("bands"), components(good, "a", "b").select(F.col("node").alias("cid"), "root")


def _compared(pairs: DataFrame, bags: DataFrame, other: str) -> DataFrame:
    """(a, b, like) of pairs of contents. Rows of a content that many pairs have are spread by their other content."""
    often = pairs.groupBy(other).agg(F.ceil(F.count(F.lit(1)) / F.lit(LOT)).cast("int").alias("lots")).filter("lots > 1")
    dealt = pairs.join(often, other, "left").withColumn("lot", F.pmod(F.xxhash64("cid"), F.coalesce("lots", F.lit(1))).cast("int"))
    theirs = bags.withColumnRenamed("cid", other).join(often, other, "left").select(other, F.col("bag").alias("y"), F.explode(F.sequence(F.lit(0), F.coalesce("lots", F.lit(1)) - 1)).alias("lot"))
    sided = dealt.join(theirs, [other, "lot"]).join(bags.select("cid", F.col("bag").alias("x")), "cid").select(F.col("cid").alias("a"), F.col(other).alias("b"), "x", "y")

    @tidied
    def verify(batches):
        for batch in batches:
            like = [overlap(_unpack(a), _unpack(b)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(like, pa.float64())], ["a", "b", "like"])

    return sided.mapInArrow(verify, "a long, b long, like double")


def similar_sets(rows: list[tuple], threshold: float) -> tuple[list[tuple[int, int]], list[int]]:
    """Links that join all similar rows (cid, root, bag), and the number of a row of each set that they and equal roots join.

    A shingle that occurs c times is c different elements, so weights shared are elements shared, for all pairs at once.
    """
    n = len(rows)
    elements, sizes = [], np.zeros(n)
    for i, (_, _, bag) in enumerate(rows):
        h, count = _unpack(bag)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        elements.append(mix(np.repeat(h, count) + nth.astype(_U) * _STEP))
        sizes[i] = len(elements[-1])
    shared = common_elements(elements)
    root, at, out = list(range(n)), {}, []

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, (cid, led, _) in enumerate(rows):
        k = at.setdefault(cid if led is None else led, i)
        root[top(i)] = top(k)
    alike = np.triu(shared >= threshold * (sizes[:, None] + sizes - shared) - 1e-9, 1) & (shared > 0)
    for i, j in zip(*(x.tolist() for x in np.nonzero(alike))):
        if top(i) != top(j):
            root[top(j)] = top(i)
            out.append((rows[i][0], rows[j][0]))
    return out, [i for i in range(n) if top(i) == i]


def _meeting(members: DataFrame, bands: DataFrame, bags: DataFrame, threshold: float, part: int = PART, most: int = MOST) -> DataFrame:
    """Links (a, b) that join the similar members of each bucket (key, cid, root, and maybe n, its members' number); a root's members are joined already.

    A bucket meets in parts of about ``part`` members; then one member of each part's joined sets meets the others', at once
    if they are ``most`` at most, or else dealt by the further bands in which they agree, as similar ones do. That joins most;
    members whose sets are still different meet in ``_across``.
    """

    @tidied
    def run(batches):
        def close(rows):
            links, heads = similar_sets([r[1:4] for r in rows], threshold)
            out = [(a, b, None, None) for a, b in links] + [(None, None, rows[i][4], rows[i][1]) for i in heads]
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out)], ["a", "b", "key", "cid"])

        rows = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and r[0] != rows[-1][0]:
                    yield close(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield close(rows)

    def joined(rows: DataFrame) -> DataFrame:
        """Links, and heads of ``rows`` (cell, cid, root, key), which meet where their cell is one."""
        with_bags = rows.join(bags.select("cid", "bag"), "cid").select("cell", "cid", "root", "bag", "key")
        return with_bags.repartition("cell").sortWithinPartitions("cell", "cid").mapInArrow(run, "a long, b long, key long, cid long")

    def in_parts(rows: DataFrame) -> DataFrame:
        if "n" not in rows.columns:
            rows = rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
        rows = rows.filter("n > 1").withColumn("parts", F.ceil(F.col("n") / F.lit(part)).cast("int"))
        return rows.select(F.xxhash64("key", F.pmod(F.xxhash64("cid"), F.col("parts"))).alias("cell"), "cid", "root", "key", "parts")

    none = F.lit(None).cast("long").alias("root")
    dealt = in_parts(members)
    whole = joined(dealt.filter("parts = 1").drop("parts")).filter("a IS NOT NULL").select("a", "b")
    several = written(dealt.filter("parts > 1").drop("parts"), "several")
    if several.isEmpty():
        return whole
    first = written(joined(several), "parts")
    heads = first.filter("a IS NULL").select("key", "cid")
    sizes = heads.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    heads = heads.join(sizes, "key")
    second = joined(heads.filter((F.col("n") <= most) & (F.col("n") > 1)).select(F.col("key").alias("cell"), "cid", none, "key"))
    large = heads.filter(F.col("n") > most).select("key", "cid").join(bands.select("cid", F.col("key").alias("further")), "cid").filter("key <> further")
    third = joined(in_parts(large.select("cid", none, F.xxhash64("key", "further").alias("key"))).drop("parts"))
    links = first.select("a", "b").unionByName(second.select("a", "b")).unionByName(third.select("a", "b")).filter("a IS NOT NULL")
    links = written(links, "links")
    # What is not one set yet meets whole.
    known = links.unionByName(several.filter("root IS NOT NULL AND root <> cid").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    of = components(known, "a", "b").withColumnRenamed("node", "cid")
    apart = several.select("key", "cid").join(of, "cid", "left").select("key", "cid", F.coalesce("root", "cid").alias("root"))
    rest = joined(_across(apart, part)).filter("a IS NOT NULL").select("a", "b")
    return whole.unionByName(links).unionByName(rest)


def _across(members: DataFrame, part: int) -> DataFrame:
    """(cell, cid, root, key) of cells of at most about twice ``part`` members, in some of which any two members of a bucket (key, cid, root) with different roots stand.

    In a bucket of several roots, parts of those outside the most frequent one meet every part of all; so few outsiders of a
    large bucket cost as many cells as it has parts. Buckets of one root have none.
    """
    members = written(members, "apart")
    sets = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    told = sets.groupBy("key").agg(F.max(F.struct("m", "root")).alias("main"), F.sum("m").alias("n")).filter("n > main.m")
    lots = lambda n: F.ceil(n / F.lit(part)).cast("int")
    told = told.select("key", F.col("main.root").alias("main"), lots(F.col("n")).alias("parts"), lots(F.col("n") - F.col("main.m")).alias("outs"))
    rows = members.join(told, "key")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("j")
    lot = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    outside = rows.filter("root <> main").select("key", "cid", "root", lot("outs").alias("i"), other("parts"))
    all_ = rows.select("key", "cid", "root", other("outs"), lot("parts").alias("i")).select("key", "cid", "root", F.col("j").alias("i"), F.col("i").alias("j"))
    return outside.unionByName(all_).select(F.xxhash64("key", "i", "j").alias("cell"), "cid", "root", "key").distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, class_size of each row of ``docs`` (doc_id, text)."""
    rows, contents, classes = near_classes(docs, threshold)
    # Equal contents are counted before the join, which then has a row for each content; rows of one content may be many.
    contents = contents.join(classes, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    total = contents.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size"))
    named = contents.select("content", "size", "root").join(total, "root").select("content", "size", "class_id", "class_size")
    return rows.join(named, ["content", "size"]).select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, its columns as they are, with one row of each class: that of the least doc_id (nulls last), then of the least content."""
    small_batches(docs.sparkSession)
    _, contents, classes = near_classes(docs, threshold)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("content"))).alias("k")
    keep = contents.join(classes, "cid", "left").groupBy(F.coalesce("root", "cid")).agg(first).select(F.col("k.doc_id").alias("kept_id"), F.col("k.content").alias("kept"))
    marked = with_content(docs)
    kept = marked.join(keep, (F.col("content") == F.col("kept")) & F.col("doc_id").eqNullSafe(F.col("kept_id")))
    again = Window.partitionBy("content", "doc_id").orderBy(F.lit(0))
    return kept.withColumn("nth", F.row_number().over(again)).filter("nth = 1").transform(unpacked, docs)


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents", "doc_id", "text"))
