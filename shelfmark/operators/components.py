"""Connected components by repeated contraction to the least neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import Stored


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Label every node of an undirected graph with its component's least node.

    Returns ``node``, ``component``; nodes without edges do not appear, and
    neither do null ends or loops on a single node. Each round ranks the nodes
    anew by a hash, replaces every node by the first of itself and its
    neighbours and keeps the distinct edges that are left. The ranks of a round
    are as good as random, so on any graph, a path of consecutive numbers
    included, a fixed share of the nodes is expected to go in each; and as the
    last node of an edge always goes, it ends. A star whose hub holds a third
    of all edges is one partial aggregate. Rounds write to the shared folder.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    now = Stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[Stored] = []
    while not now.df.isEmpty():
        rank = lambda c, n=len(maps): F.struct(F.xxhash64(F.col(c), F.lit(n)).alias("h"), F.col(c).alias("x"))
        both = now.df.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            now.df.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        first = both.groupBy("node").agg(F.min(rank("other")).alias("near"))
        step = Stored(first.select("node", F.least(rank("node"), F.col("near"))["x"].alias("to")), "step")
        maps.append(step)
        ends = (
            now.df.join(step.df.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(step.df.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        after = Stored(ends, "edges")
        now.drop()
        now = after
    if not maps:
        return now.df.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    # Compose the rounds' maps from the last to the first; what they lead to is some node of the component.
    final: Stored | None = None
    for step in reversed(maps):
        if final is None:
            final = Stored(step.df.select("node", F.col("to").alias("root")), "labels")
            continue
        out = step.df.alias("s").join(final.df.alias("f"), F.col("s.to") == F.col("f.node"), "left")
        composed = Stored(out.select("s.node", F.coalesce("f.root", "s.to").alias("root")), "labels")
        final.drop()
        final = composed
    for step in maps:
        step.drop()
    now.drop()
    # The root itself is a node of the table, so the least node is that of all that lead to it.
    least = final.df.groupBy("root").agg(F.min("node").alias("component"))
    return final.df.join(least, "root").select("node", "component")
