"""Connected components of an edge table, by alternating large and small stars.

Each round is two grouped minima joined back to the edges (Kiveris et al., 2014);
rounds grow with the logarithm of the longest path. Minima are pre-aggregated before
they are shuffled, and the join back is an equi-join that adaptive execution splits
where a node has very many edges. Lineage is cut by a table in a shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.session import run_dir


def store(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = f"{run_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of ``edges`` (u, v) that isn't its component's
    least node; the component is that least node. Nodes may be of any ordered type;
    null ends and loops are left out."""
    current = store(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct(), "cc")
    mark = None
    for _ in range(most_rounds):
        current = store(_small_star(_large_star(current)), "cc")
        now = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return current.select(F.col("u").alias("id"), F.col("v").alias("component"))
        mark = now
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")
