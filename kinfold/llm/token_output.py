"""Token ids in a binary file format: one zstandard frame for each document, all under one trained dictionary.

A file set has two parts under its folder:

* ``dictionary``: one row, the dictionary's bytes and their sha256 (none where there was too little to train on);
* ``blocks``: rows of consecutive documents in ascending ``doc_id`` order (null first, equal ids by text). ``part`` and
  ``block`` order the rows. ``payload`` is the documents' frames end to end; ``ends`` has where each frame ends and
  ``n_tokens`` its ids, ``tokens_before`` the ids of the part before the block; ``dict_sha256`` names the dictionary.
  Ids are little-endian unsigned integers of ``id_bytes`` bytes.

Parquet is the container, so files are committed by Spark's writer on any store, and a read by ``doc_id`` skips row
groups by ``first_doc_id`` and ``last_doc_id`` and decompresses single frames.

Defined results: a null or empty text is the end id alone; repeated ids are written each; an empty table gives no rows;
other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.common import load, new_path, slices, small_batches, text_buffer, tidied

#: The dictionary is trained on about this many documents (those of the lowest id hashes), of each at most this many characters.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 500, 20_000, 64 << 10
LEVEL = 3
#: A block is closed when its frames have this many bytes.
BLOCK_BYTES = 1 << 20
END_ID = 2
#: Distinct pieces of text whose ids a worker keeps.
CACHE = 250_000

_KIND = np.zeros(256, np.uint8)  # 1 letter, 2 white space, 3 lead byte of two-byte letters, 4 lead byte that needs a look
_KIND[65:91] = _KIND[97:123] = 1
_KIND[[9, 10, 11, 12, 13, 32]] = 2
_KIND[0xC0:] = 4
_KIND[0xC3:0xCA] = 3
_APOSTROPHE = 39
#: What the byte-level alphabet has for a space.
_SPACE = "\u0120"


class Encoder:
    """Ids of whole texts by the tokenizers library; the ids of pieces met before are looked up.

    The tokenizer's pattern always cuts before a run of letters, or before the one white space before it, and after the
    run; so texts are cut there, and each distinct piece of a slice is encoded by the library once. Texts with letters
    beyond Latin, with other unusual characters, with an added token's string, or with an apostrophe before but not after a
    letter are encoded whole; so are all texts if the tokenizer's file says that it cuts by another pattern or normalises.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        #: Their strings in a text are one id each, so such a text can't be cut.
        self.added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.vocab = self.tok.get_vocab_size()
        self.cuts = _cuts_before_letters(self.tok)
        self.known: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text."""
        if not self.cuts:
            return [np.frombuffer(self.whole(t or ""), np.uint32) for t in texts.to_pylist()]
        buf, offsets = text_buffer(texts)
        out: list[np.ndarray] = []
        for i, j in slices(offsets, 1 << 20):
            raw, off = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            start, odd = cuts(raw, off)
            data = raw.tobytes()
            if any(t in data for t in self.added):
                odd = sorted({*odd, *(k for k in range(j - i) if any(t in data[off[k] : off[k + 1]] for t in self.added))})
            ids, ends = self._pieces(raw, start)
            at = np.append(0, ends)[np.searchsorted(start, off)]
            out += [ids[at[k] : at[k + 1]] for k in range(j - i)]
            for k in odd:
                out[i + k] = np.frombuffer(self.whole(raw[off[k] : off[k + 1]].tobytes().decode()), np.uint32)
        return out

    def _new(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces. One word of ASCII letters, with at most a space before, is one piece for the pattern as well (``cuts`` says so), so it goes to the library's model directly; all else goes through the whole library."""
        model, out, other = self.tok.model, [], []
        for i, p in enumerate(pieces):
            if (p[1:] if p[0] == 32 else p).isalpha():
                out.append([t.id for t in model.tokenize(p.decode().replace(" ", _SPACE))])
            else:
                out.append([])
                other.append(i)
        for i, e in zip(other, self.tok.encode_batch_fast([pieces[i].decode(errors="replace") for i in other], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def _pieces(self, raw: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and where each piece's end. Equal pieces, by their bytes, are looked up once."""
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        offsets = np.append(start, len(raw)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        which, known, (_, at, data) = coded.indices.to_numpy(), self.known, coded.dictionary.buffers()
        ends, data = np.frombuffer(at, np.int32)[: len(coded.dictionary) + 1].tolist(), data.to_pybytes()
        keys = [data[a:b] for a, b in zip(ends, ends[1:])]
        found = list(map(known.get, keys))
        if new := [i for i, v in enumerate(found) if v is None]:
            if len(known) + len(new) > CACHE:
                known.clear()
            for i, ids in zip(new, self._new([keys[i] for i in new])):
                found[i] = known[keys[i]] = array("I", ids).tobytes()
        ids = np.frombuffer(b"".join(found), np.uint32)
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ends = np.cumsum(n[which])
        shift = (np.cumsum(n) - n)[which] - (ends - n[which])
        return ids[np.repeat(shift, n[which]) + np.arange(ends[-1])], ends


def cuts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Starts of pieces, and the texts that must be encoded whole."""
    n = len(raw)
    kind = _KIND[raw]
    letter = kind == 1
    odd = np.zeros(n, bool)
    lead = np.flatnonzero(kind >= 3)
    if len(lead):
        after = np.append(raw, [0, 0])
        b, b1, b2 = raw[lead], after[lead + 1], after[lead + 2]
        is_letter = (kind[lead] == 3) & ~((b == 0xC3) & ((b1 == 0x97) | (b1 == 0xB7))) & ~((b == 0xC9) & (b1 > 0x8F))
        plain = ((b == 0xC2) & ((b1 == 0xAB) | (b1 == 0xBB))) | ((b == 0xE2) & (b1 == 0x80) & (b2 >= 0x90) & (b2 <= 0xA7))
        letter[lead[is_letter]] = letter[lead[is_letter] + 1] = True
        odd[lead[~is_letter & ~plain]] = True
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # a text starts or ends
    mark = np.flatnonzero(raw == _APOSTROPHE)
    if len(mark):
        before = letter[mark - 1] & ~first[mark] & (mark > 0)
        following = np.append(letter, False)[mark + 1] & ~first[mark + 1]
        odd[mark[following & ~before]] = True
        letter[mark[following & before]] = True
    cut = first[:n].copy()
    if n:
        change = letter[1:] != letter[:-1]
        begins = np.flatnonzero(letter & np.append(True, change | first[1:n]))
        ends = np.flatnonzero(~letter & np.append(False, change))
        cut[ends] = True
        space = (begins > 0) & (kind[begins - 1] == 2) & ~first[begins]
        cut[begins - space] = True
        # A white space that goes with the letters after it; what went before it is a piece that ends there.
    start = np.flatnonzero(cut)
    texts = np.unique(np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1)
    return start, texts.tolist()


def _cuts_before_letters(tok) -> bool:
    """Whether the tokenizer is a byte-level one with that scheme's own pattern, on the text as it is; tried on a few words, too."""
    said = json.loads(tok.to_str())
    cutter, model = said["pre_tokenizer"] or {}, said["model"]
    plain = said["normalizer"] is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
    if not plain or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return False
    tried = [" the", "The", " a", "Zq", " internationalisation", " Xyzzyx"]
    return all(tok.encode(t, add_special_tokens=False).ids == [x.id for x in tok.model.tokenize(t.replace(" ", _SPACE))] for t in tried)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def train(samples: Sequence[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary for ``samples``; empty where there is too little to train on."""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 4), list(samples)).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _dict(data: bytes):
    return zstandard.ZstdCompressionDict(data) if data else None


BLOCK_SCHEMA = (
    "part int, block int, first_doc_id long, last_doc_id long, n_docs int, tokens_before long, id_bytes int, dict_sha256 string,"
    " doc_ids array<long>, n_tokens array<int>, ends array<int>, payload binary"
)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, vocab: int | None = None) -> None:
    """Writes ``docs`` (doc_id, text) as a file set. ``tokenizer``: path of a tokenizers file, there on every machine."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    width = 2 if max(vocab or encoder(tokenizer).vocab, end_id + 1) <= 1 << 16 else 4
    # The sample, a bounded number of bounded texts: hashes below a share of their range, so no task sends more than its part.
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    below = F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(SAMPLE_DOCS)).cast("double") < (share - 0.5) * 2.0**64
    sample = docs.filter(below).select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).limit(2 * SAMPLE_DOCS).collect()
    data = train([_narrow(x, width, end_id) for x in encoder(tokenizer).encode(pa.array(sorted(r["text"] for r in sample), pa.string()))])
    sha = hashlib.sha256(data).hexdigest() if data else None
    spark.createDataFrame([(sha, data)], "dict_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    @tidied
    def run(batches):
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        comp = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dict(data), write_checksum=False)
        frames, ids, counts, size, block, before = [], [], [], 0, 0, 0

        def close():
            nonlocal frames, ids, counts, size, block, before
            row = [[part], [block], [ids[0]], [ids[-1]], [len(ids)], [before], [width], [sha], [ids], [counts], [np.cumsum([len(f) for f in frames]).tolist()], [b"".join(frames)]]
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, _TYPES)], _NAMES)
            block, before, frames, ids, counts, size = block + 1, before + sum(counts), [], [], [], 0
            return out

        for batch in batches:
            for doc_id, got in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1))):
                raw = _narrow(got, width, end_id)
                frame = comp.compress(raw)
                if ids and size + len(frame) > BLOCK_BYTES:
                    yield close()
                frames.append(frame)
                ids.append(doc_id)
                counts.append(len(raw) // width)
                size += len(frame)
        if ids:
            yield close()

    (docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text").mapInArrow(run, BLOCK_SCHEMA).write.parquet(f"{path}/blocks"))


_NAMES = [f.strip().split(" ")[0] for f in BLOCK_SCHEMA.split(",")]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]


def _narrow(ids: np.ndarray, width: int, end_id: int) -> bytes:
    out = np.empty(len(ids) + 1, f"<u{width}")
    out[:-1] = ids
    out[-1] = end_id
    return out.tobytes()


def read(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document of a file set, or of those asked for."""
    kept = spark.read.parquet(f"{path}/dictionary").collect()[0]
    data, sha = bytes(kept["dictionary"]), kept["dict_sha256"]
    if data and hashlib.sha256(data).hexdigest() != sha:
        raise ValueError("the dictionary isn't the one that was written")
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    # One row for each part, a part being one task of the writer: the table is as small as that job's list of tasks.
    totals = blocks.groupBy("part").agg(F.max(F.col("tokens_before") + F.aggregate("n_tokens", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    starts = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    want = None
    if doc_ids is not None:
        want = sorted(set(doc_ids))
        hit = F.lit(False)
        for i in want:
            hit = hit | ((F.col("first_doc_id").isNull() | (F.col("first_doc_id") <= i)) & (F.col("last_doc_id") >= i))
        blocks = blocks.filter(hit)
    wanted = None if want is None else set(want)

    @tidied
    def run(batches):
        dec = zstandard.ZstdDecompressor(dict_data=_dict(data))
        for batch in batches:
            cols = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                if cols["dict_sha256"][k].as_py() != sha:
                    raise ValueError("a block was written under another dictionary")
                payload, width, start, at = memoryview(cols["payload"][k].as_buffer()), cols["id_bytes"][k].as_py(), cols["part_start"][k].as_py() + cols["tokens_before"][k].as_py(), 0
                out = []
                for doc_id, n, end in zip(cols["doc_ids"][k].as_py(), cols["n_tokens"][k].as_py(), cols["ends"][k].as_py()):
                    if wanted is None or doc_id in wanted:
                        ids = np.frombuffer(dec.decompress(payload[at:end], max_output_size=n * width), f"<u{width}").astype("<u4")
                        if len(ids) != n:
                            raise ValueError(f"document {doc_id} has {len(ids)} ids; its index says {n}")
                        out.append((doc_id, start, n, zlib.crc32(ids.tobytes()), ids if with_ids else None))
                    start, at = start + n, end
                arrays = [pa.array([r[j] for r in out], pa.int64()) for j in range(4)]
                if with_ids:
                    arrays.append(pa.array([r[4] for r in out], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    cols = ["part", "tokens_before", "id_bytes", "dict_sha256", "doc_ids", "n_tokens", "ends", "payload"]
    joined = blocks.select(*cols).join(F.broadcast(starts), "part")
    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def token_output(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """Writes ``docs`` as a file set in the shared folder and reads it back."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write(docs, path, tokenizer)
    return read(spark, path, with_ids=with_ids)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(load(spark, sf_dir, "documents", "doc_id", "text"), default_tokenizer())
