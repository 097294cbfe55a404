"""Written tables that cut lineage, and dense numbering without a single-task window."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where the session names none, a local one gets a temporary folder; on a cluster, whose machines don't share one, that is an error."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("kinfold.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="kinfold-")
        spark.conf.set("kinfold.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in this application's part of the shared folder."""
    return f"{shared_dir(spark)}/kinfold/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes the tables this application has written; frames that read them can't be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/kinfold/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder: lineage ends there, and lost executors lose nothing."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    _made.append(path)
    return out


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int | None = None) -> DataFrame:
    """``df`` as ``written``, in sorted buckets by ``keys``, as many as the session's partitions if not said: windows and joins by these read it without an exchange or a sort."""
    spark = df.sparkSession
    path, table, n = new_path(spark, name), f"kinfold_{uuid.uuid4().hex}", buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A task for each bucket, so a bucket is one file.
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).format("parquet").option("path", path).saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolved now, so the name isn't needed any more
    spark.sql(f"DROP TABLE {table}")  # the files stay
    out._written_at = path
    _made.append(path)
    return out


_made: list[str] = []


@contextmanager
def swept(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes the tables written within, at the end, but those put into the list that it gives."""
    since, kept = len(_made), []
    try:
        yield kept
    finally:
        keep = {t._written_at for t in kept}
        fs = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).getFileSystem(spark._jsc.hadoopConfiguration())
        for path in _made[since:]:
            if path not in keep:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)
        _made[since:] = [p for p in _made[since:] if p in keep]


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nothing refers to any more; it does so when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows of input that one task gets where each makes several rows, which it aggregates.
ROWS_A_TASK = 250_000


def tasks_for(rows: DataFrame, each: int = ROWS_A_TASK) -> int:
    """Into how many partitions ``rows``, a table as read, are to be dealt so that one has about ``each`` rows, whatever their number; as many as the session says, at least.

    Spark counts a table's rows from its files' footers. Left to itself it puts partitions together by their compressed bytes, far fewer than a task's memory for them.
    """
    least = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * rows.sparkSession.sparkContext.defaultParallelism)
    return max(least, -(-rows.count() // each))


def dealt(df: DataFrame, *keys: str | Column, tasks: int | None = None) -> DataFrame:
    """``df`` in partitions that hold all rows of a key each, also where no Spark operator asks for that (``mapInArrow``); as many as the session says, or ``tasks``.

    Where rows come from joins by the same key, Spark leaves a plain ``repartition`` out, and then its adaptive execution may spread a key's
    rows over several tasks: the two sides of a union are put together apart, and a join that turns into a broadcast reads its rows where they lie.
    A hash of the keys is no partitioning that rows have already.
    """
    by = F.xxhash64(*keys)
    return df.repartition(by) if tasks is None else df.repartition(tasks, by)


#: Bytes of a table that ``few_broadcasts`` lets Spark broadcast.
MOST_BROADCAST = 256 << 10


@contextmanager
def few_broadcasts(spark: SparkSession, most: int = MOST_BROADCAST) -> Iterator[None]:
    """Within, Spark broadcasts tables of ``most`` bytes at most; a lower limit of the session stands.

    The size of a written table is that of its compressed files, which says little of the rows the driver would hold; a loop
    of many joins would hold many such tables at once.
    """
    size, limits = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes, {}
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        now = spark.conf.get(key) if "adaptive" not in key else spark.conf.get(key, None)
        if now is not None and not now.startswith("-") and size(now) > most:  # below 0: no broadcasts at all
            limits[key] = now
    try:
        for key in limits:
            spark.conf.set(key, str(most))
        yield
    finally:
        for key, was in limits.items():
            spark.conf.set(key, was)


#: Bytes that one task reads of files or of a shuffle, within ``small_tasks``. Numbers compress well: so many bytes are far more in memory.
TASK_BYTES = 8 << 20


@contextmanager
def small_tasks(spark: SparkSession, tasks: int) -> Iterator[None]:
    """Within, shuffles have ``tasks`` partitions at least, and tasks read ``TASK_BYTES`` of files or shuffles at most, so their memory doesn't grow with the tables; settings that ask for less stand."""
    size, said = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes, {}
    want = {"spark.sql.shuffle.partitions": max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))}
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
        want[key] = min(TASK_BYTES, size(spark.conf.get(key)))
    try:
        for key, value in want.items():
            said[key] = spark.conf.get(key)
            spark.conf.set(key, str(value))
        yield
    finally:
        for key, was in said.items():
            spark.conf.set(key, was)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """``df`` with a gapless number from 0 in ``order``: ranges are numbered apart, each from where the one before ends."""
    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()), "numbered")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))  # a row for each task
    row = F.row_number().over(Window.partitionBy("_part").orderBy("_seq")) - 1
    return ranged.withColumn("_row", row).join(F.broadcast(starts), "_part").withColumn(name, F.col("_from") + F.col("_row")).drop("_part", "_seq", "_row", "_from")


def ranked(df: DataFrame, keys: list[str], order: list[str], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without ``drop``, as a written table, with ``rn``, a row's place from 0 in ``order`` among those of its keys, and ``n``, how many there are.

    Rows are sorted in ranges of keys and order, so many rows of one key spread over tasks. A row knows its place in its task;
    where a key's rows begin in a task, and how many of them earlier tasks have, is a table of a row for each key and task.
    """
    return with_ranks(in_ranges(df, keys, order, drop), keys)


def in_ranges(df: DataFrame, keys: list[str], order: list[str], drop: tuple[str, ...] = (), within: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``df`` without ``drop`` as a written table, sorted in ranges of keys and order, with a row's task and place, ``_part`` and ``_at``. ``within`` may leave out rows; those equal in keys and order are in one range."""
    by = [F.col(c) for c in (*keys, *order)]
    ranged = df.repartitionByRange(*by)
    ranged = (within(ranged) if within else ranged).sortWithinPartitions(*by)
    return written(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")).drop(*drop), "ranked")


def with_ranks(ranged: DataFrame, keys: list[str]) -> DataFrame:
    """``ranged``, a table of ``in_ranges``, as of ``ranked``."""
    each = ranged.groupBy("_part", *keys).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    of_key = Window.partitionBy(*keys)
    before = of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    starts = each.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], shift, F.sum("_n").over(of_key).alias("n"))
    starts = written(starts, "starts")  # so Spark knows how small it is, and doesn't move the rows to meet it
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_{i}"))
    return ranged.join(starts, same).select(*[c for c in ranged.columns if c not in ("_part", "_at")], (F.col("_at") + F.col("_shift")).alias("rn"), "n")
