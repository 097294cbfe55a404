"""New search results as a stream of files: each batch of arriving files is a part of a hits table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinfold.sources.hits import parsed


def follow_hits(spark: SparkSession, directory: str, table_path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends hits with ``file`` and ``line_no``, as ``read_outfmt6`` gives them, to a table partitioned by ``epoch``; self hits and unparsable lines are left out.

    A repeated epoch overwrites its own partition, so it adds no rows. Repeated pairs are resolved by ``genome_hits`` when the table is read.
    """
    stream = spark.readStream.text(directory)
    lines = stream.select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def write(batch: DataFrame, epoch: int) -> None:
        placed = batch.select("value", "file", F.struct("block", F.monotonically_increasing_id().alias("line")).alias("line_no"))
        parsed(placed)[0].filter("query <> subject").write.mode("overwrite").parquet(f"{table_path}/epoch={epoch}")

    writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()
