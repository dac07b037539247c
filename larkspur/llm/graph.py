"""Connected components of an undirected graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` -> ``(node, comp)`` for every node of an edge; ``comp`` is the least node it is connected to.

    Each round hangs the larger neighbours of a node on the least one (large star), then all
    neighbours of a node that are not above it (small star), until all that is left are stars.  Rounds
    grow with the logarithm of the longest path; a node's neighbours are only ever grouped to a minimum
    and counts and joined, never collected.  Rounds are cut by checkpoints in the shared folder, the last
    of which is the result.
    """
    up = checkpointed(edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a <> b").distinct())
    while True:
        both = up.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        # a table of its own, so that adaptive execution can split the pairs of a node with very many
        low = checkpointed(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count_if(F.col("b") < F.col("a")).alias("below"), F.count_if(F.col("b") > F.col("a")).alias("above")))
        if low.where("below > 1 OR below > 0 AND above > 0").isEmpty():
            return low.select(F.col("a").alias("node"), F.col("m").alias("comp"))
        large = both.join(low.select("a", "m"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = small.select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
        up = checkpointed(small.where("a <> b").distinct())
