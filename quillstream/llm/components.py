"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a partial aggregate (the least neighbour of every node) and a join back to the
edges, so a node with very many neighbours is combined before the shuffle and its edges are
split by adaptive skew handling. Every step's edges are written to the shared folder, so
lineage stays short and a lost executor costs one step.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import remove_dir, fresh_dir


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return edges.select("u", "v").unionByName(back)


def components(links: DataFrame, a: str = "a", b: str = "b", *, max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node that has a link; component is its least node.

    Links may repeat, run either way or be loops; links with a null end are ignored. An empty
    table gives no rows.
    """
    spark = links.sparkSession
    schema = links.select(F.col(a).alias("u"), F.col(b).alias("v")).schema
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter(F.col("u") != F.col("v"))
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    last, at = None, None
    for _ in range(max_rounds):
        both = _both(edges)
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()  # each v of u now hangs on the least of u's star
        small = _least(large)
        moved = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = moved.unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        path = fresh_dir(spark, "stars")
        step.write.parquet(path)
        edges = spark.read.schema(schema).parquet(path)
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if at:
            remove_dir(spark, at)
        at = path
        if seen == last:
            break
        last = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the sets of nodes i and j, pair by pair, in ``label`` (each node's least fellow so far)."""
    while True:
        a, b = label[i], label[j]
        live = a != b
        if not live.any():
            return
        i, j, a, b = i[live], j[live], a[live], b[live]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]
