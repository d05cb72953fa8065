"""Connected components of an edge table, without collecting it on the driver.

What fits in one task, at most ``EDGES_PER_TASK`` edges, is settled there.  More edges are dealt
to as many tasks as that takes, each reduces its own to a spanning forest of stars, as an
aggregation sums before it shuffles, and alternating large-star and small-star steps follow: each
joins every edge with the smallest neighbour of one end, so the work of a step is in proportion
to the edges and the number of steps grows with the logarithm of the longest path.  Each step's
edges are written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written

#: Edges that one task holds at once, 8 MB of longs.
EDGES_PER_TASK = 500_000


def roots_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For the nodes 0 to ``n`` - 1 of the edges ``a``, ``b`` the smallest node each reaches."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (jumped := new[new] != new).any():
            new[jumped] = new[new[jumped]]
        if (new == root).all():
            return root
        root = new


def _forest(most: int):
    """The edges of a task as stars around the smallest node of each of its components, at most
    ``most`` edges at a time."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ends = [table.column(k).to_numpy() for k in (0, 1)]
        nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
        root = roots_of(at[: len(ends[0])], at[len(ends[0]) :], len(nodes))
        leaf = root != np.arange(len(nodes))
        kind = table.schema.field(0).type
        return pa.RecordBatch.from_arrays([pa.array(nodes[root[leaf]], kind), pa.array(nodes[leaf], kind)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size > most:
                yield stars(held)
                held, size = [], 0
        if size:
            yield stars(held)

    return run


def _stars(edges: DataFrame, files: int) -> DataFrame:
    """Large-star: connect every larger neighbour of a node with the node's smallest one."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    least = written(least, "least", files=files)  # apart from its join, whose hubs can then be split
    large = both.filter("v > u").join(least.hint("merge"), "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return large.filter("a <> b").distinct()


def _small(edges: DataFrame, files: int) -> DataFrame:
    """Small-star: connect a node and its smaller neighbours with the smallest of them."""
    least = written(edges.groupBy("b").agg(F.min("a").alias("m")), "least", files=files)
    joined = edges.join(least.hint("merge"), "b").select("a", "b", "m")
    out = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), "b"))
    return out.filter("a <> b").distinct()


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node is either the root of its edges or the leaf of one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(0).alias("leaf")).union(edges.select("b", F.lit(1)))
    return ends.groupBy("node").agg(F.min("leaf").alias("least"), F.sum("leaf").alias("leaves")).filter("leaves > 1 or (leaves = 1 and least = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node reachable) for every node that has an edge.

    ``edges`` has two columns of one orderable type; order within an edge and repeats do not
    matter, loops are ignored.  No edges give an empty result.
    """
    first, second = edges.columns[:2]
    edges = edges.filter(F.col(first) != F.col(second)).select(F.least(first, second).alias("a"), F.greatest(first, second).alias("b")).distinct()
    edges = written(edges, "edges", per_core=4)
    while tasks := -(-edges.count() // EDGES_PER_TASK):
        dealt = edges.coalesce(1) if tasks == 1 else edges.repartition(tasks)
        edges = written(dealt.mapInArrow(_forest(EDGES_PER_TASK if tasks > 1 else 1 << 60), edges.schema), "forest", files=tasks)
        if tasks == 1 or _only_stars(edges):
            break
        stars = written(_stars(edges, tasks), "stars", files=tasks)
        edges = written(_small(stars, tasks), "edges", files=tasks)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
