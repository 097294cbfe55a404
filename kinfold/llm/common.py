"""What several operators share: written tables, Arrow batches, text buffers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.plans.tables import new_path, written  # noqa: F401  for the operators

#: Rows and bytes of an Arrow batch sent to Python: long texts make larger batches take too much memory. A longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Bytes of text that the numpy kernels work on at once; a longer single text is one slice.
SLICE_BYTES = 1 << 19


def small_batches(spark: SparkSession) -> None:
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) > BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


def load(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns only, so that extra columns can't clash with those an operator adds."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def tidied(run: Callable) -> Callable:
    """``run``, a function of a partition's batches, which gives free memory back to the system at the partition's end: Spark keeps its workers."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array without a copy; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def crc_mod5(doc_id):
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def keep_rows(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """Rows of ``docs``, all columns as they are, for whose texts ``keep`` gives true; no shuffle."""
    rows = docs.select(packed(docs).alias("row"), docs["text"])

    @tidied
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(1)), pa.bool_()))

    return unpacked(rows.mapInArrow(run, rows.schema), docs)


def packed(docs: DataFrame) -> Column:
    """A row's columns as they are, whatever their names, in one; ``unpacked`` gives them back."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns])


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from the column ``row`` of ``rows``."""
    return rows.select(*[rows["row"].getField(c).alias(c) for c in docs.columns])
