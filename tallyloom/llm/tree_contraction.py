"""Subtree totals by parallel tree contraction: leaves are raked into their parents and unary chains compressed, round after round; then what was compressed is expanded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import written


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """(node, values): for each node the sums of its own and its descendants' values. tree, a written table: (node, parent, values as longs), parent null at a root; node is unique.

    A round rakes all leaves: their totals are final and are added to their parents, grouped by parent with sums that combine before
    the shuffle, so a node may have any number of children. Then of the nodes left with one child those whose hash is below their
    child's and their parent's, a third of a long chain, are compressed: the child goes to the grandparent and carries on its edge what the
    node had gathered, and the node is noted with its child. Rounds grow with the logarithm of the tree's size, not
    with its depth. At the end the notes are read backwards: a node's total is its child's with what was noted. Each round is a
    written table; those that expansion reads shrink with the rounds.
    """
    kids = tree.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("p")).agg(F.count("*").alias("kids"))
    edge = [f"edge_{v}" for v in values]
    live = tree.join(kids, F.col("node") == F.col("p"), "left").select("node", "parent", F.coalesce("kids", F.lit(0)).alias("kids"), *values, *(F.lit(0).cast("long").alias(e) for e in edge))
    live = written(live, "live")
    finished, notes, turn = [], [], 0
    while True:
        finished.append(live.where("kids = 0").select("node", *values))
        leaf, rest = F.col("kids") == 0, F.col("kids") > 0
        below = live.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("p")).agg(
            F.count_if(rest).alias("left"), F.min(F.when(rest, F.col("node"))).alias("child"),
            *(F.sum(F.when(leaf, F.col(v) + F.col(e)).otherwise(0)).alias(f"raked_{v}") for v, e in zip(values, edge)),
            *(F.sum(F.when(rest, F.col(e)).otherwise(0)).alias(f"child_{e}") for e in edge))
        raked = live.where(rest).join(below, F.col("node") == F.col("p"))
        own = F.xxhash64("node", F.lit(turn))
        compress = (F.col("left") == 1) & F.col("parent").isNotNull() & (own < F.xxhash64("child", F.lit(turn))) & (own < F.xxhash64("parent", F.lit(turn)))
        raked = raked.select("node", "parent", F.col("left").alias("kids"), *((F.col(v) + F.col(f"raked_{v}")).alias(v) for v in values), *edge, "child", *(f"child_{e}" for e in edge), F.coalesce(compress, F.lit(False)).alias("compressed"))
        raked = written(raked, "raked")
        n, gone = raked.agg(F.count("*"), F.count_if("compressed")).first()
        if not n:
            break
        columns = ["node", "parent", "kids", *values, *edge]
        notes.append((turn, raked.where("compressed").select("node", "child", *((F.col(v) + F.col(f"child_{e}")).alias(v) for v, e in zip(values, edge))) if gone else None))
        live = raked.where("not compressed").select(*columns)
        if gone:
            passed = raked.where("compressed").select(F.col("child").alias("c"), F.col("parent").alias("up"), *((F.col(v) + F.col(e)).alias(f"up_{v}") for v, e in zip(values, edge)))
            live = live.join(passed, F.col("node") == F.col("c"), "left").select("node", F.coalesce("up", "parent").alias("parent"), "kids", *values, *((F.col(e) + F.coalesce(f"up_{v}", F.lit(0))).alias(e) for v, e in zip(values, edge)))
            live = written(live, "live")
        turn += 1
    # a node compressed in a round has a child that was raked or compressed in a later one
    known = finished.copy()
    for at, noted in reversed(notes):
        if noted is not None:
            later = reduce(DataFrame.unionByName, known[at + 1 :]).select(F.col("node").alias("c"), *(F.col(v).alias(f"of_{v}") for v in values))
            known.append(written(noted.join(later, F.col("child") == F.col("c")).select("node", *((F.col(v) + F.col(f"of_{v}")).alias(v) for v in values)), "expanded"))
    return reduce(DataFrame.unionByName, known)
