"""Connected components of a graph given as rows of two node ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import removed, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node long, root long): root is the smallest node of node's component. edges: (a long, b long), any order, repeats allowed.

    Large-star and small-star rounds until no edge changes. A round groups edges by node with min(), which
    combines before the shuffle, and joins that min back; a hub's edges are split by the skew-join rule, and
    no neighbour list is ever gathered. Each round is written to the shared folder.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = lambda: edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = state()
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        older, edges = edges, written(small.where("a <> b").distinct(), "edges")
        removed(edges.sparkSession, *{f.rpartition("/")[0] for f in older.inputFiles()})
        before, seen = seen, state()
        if seen == before:
            break
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
