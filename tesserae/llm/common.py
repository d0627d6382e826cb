"""What the operators of this subpackage share with the library: tables, the shared folder, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import graph
from tesserae.operators.iterate import drop_path, new_path, shared_dir, ship, written

__all__ = ["components", "counted", "drop_path", "new_path", "shared_dir", "ship", "table", "unused", "written"]

#: Tables of up to so many rows, counted first, are broadcast: rows of a few numbers, so some tens of MB.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) as (node, root), root being the least node. Null ends and loops are ignored."""
    return graph.components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def unused(columns: list[str], *names: str) -> list[str]:
    """names, each with underscores behind it until no column is called so in any case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def counted(df: DataFrame, name: str) -> DataFrame:
    """df of a few numbers a row as a written table, marked for a broadcast only if its counted rows are at most BROADCAST_ROWS."""
    held = written(df, name)
    return F.broadcast(held) if held.count() <= BROADCAST_ROWS else held
