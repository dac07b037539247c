"""Graphs as edge tables: adjacency in rows, and dense cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import running


def mirrored(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """Both directions of undirected edges; a loop once."""
    back = edges.where(F.col(source) != F.col(target)).select(F.col(target).alias(source), F.col(source).alias(target), *[c for c in edges.columns if c not in (source, target)])
    return edges.select(source, target, *[c for c in edges.columns if c not in (source, target)]).union(back)


def adjacency(edges: DataFrame, source: str = "src", target: str = "dst", weight: str = "weight") -> DataFrame:
    """``(src, neighbours, weights, degree)`` of each node with edges, neighbours in order; a row's place in the arrays of a compressed graph is the running sum of degrees by node."""
    pairs = F.sort_array(F.collect_list(F.struct(target, weight)))
    grouped = edges.groupBy(source).agg(pairs.alias("p"))
    return grouped.select(source, F.transform("p", lambda t: t[target]).alias("neighbours"), F.transform("p", lambda t: t[weight]).alias("weights"), F.size("p").alias("degree"))


def with_offsets(rows: DataFrame, source: str = "src") -> DataFrame:
    """First place of each node's edges among all edges, in order of nodes."""
    return running(rows, source, "offset", amount="degree")


def dense(edges: DataFrame, nodes: DataFrame, missing: float = 0.0, source: str = "src", target: str = "dst", weight: str = "weight", most: int = 10_000) -> DataFrame:
    """All cells ``(src, dst, weight)`` between nodes: absent edges are ``missing``, the diagonal is 0 where there is no loop.  More than ``most`` nodes raise."""
    if nodes.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} nodes")
    a, b = nodes.select(F.col(nodes.columns[0]).alias(source)), nodes.select(F.col(nodes.columns[0]).alias(target))
    cells = a.join(b, F.lit(True)).join(edges.select(source, target, weight), [source, target], "left")
    return cells.withColumn(weight, F.coalesce(weight, F.when(F.col(source) == F.col(target), 0.0).otherwise(F.lit(float(missing)))))
