"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.components import connected_components


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link, ``root`` being the least node of its component."""
    return connected_components(links, a, b).select("node", F.col("component").alias("root"))
