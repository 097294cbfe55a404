"""What the jobs share: config files, command lines, logging."""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import fields
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

Config = TypeVar("Config")


def default_config(job_file: str, cls: type[Config]) -> Config:
    """The config file that lies beside a job."""
    return cls(**json.loads(Path(job_file).with_suffix(".json").read_text()))


def load_config(spark: SparkSession, path: str, cls: type[Config]) -> Config:
    """A config file from anywhere that Spark reads."""
    said = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    unknown = set(said) - {f.name for f in fields(cls)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return cls(**said)


def command_line(description: str, paths: list[str]) -> dict[str, str | None]:
    p = argparse.ArgumentParser(description=description)
    for name in paths:
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", help="a JSON file; by default the one beside the job")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return vars(p.parse_args())


def spread(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the rows of a partition together; a large partition's rows are spread over tasks by AQE."""
    return df.hint("rebalance", *by)


def write_partitions(df: DataFrame, path: str, by: list[str], rows_per_file: int) -> None:
    """Overwrites the partitions that ``df`` has rows of, and no others; each task that has rows of a partition writes a file there."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).partitionBy(*by).parquet(path)


def make_empty(spark: SparkSession, path: str, schema: str, by: list[str]) -> None:
    """Makes the folder of a partitioned table, so that it can be read before it has rows; a table that is there stays as it is."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy(*by).parquet(path)
