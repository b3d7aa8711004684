"""Connected components: of a counted, bounded number of edges in one task, of more by alternating large-star and small-star steps,
each a pair of shuffles over the edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.scratch import stash


#: Edges (16 bytes each) that one task may hold.
ONE_TASK = 1_000_000


def _least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, the least node of its component): labels sink along edges and are then followed to their ends, until nothing changes."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(node))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for end in (x, y):
            np.minimum.at(new, label[end], low)
            np.minimum.at(new, end, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return node, node[label]
        label = new


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """edges: a, b (long). node and comp (the least node that it reaches) of every node with an edge to another.

    Steps go on until every node points straight at the least of its component; no label or edge comes to the driver.
    """
    e = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    if e.limit(one_task + 1).count() <= one_task:

        def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
            if rows:
                node, comp = _least_labels(*(np.concatenate(x) for x in zip(*rows, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(comp)], ["node", "comp"])

        return e.coalesce(1).mapInArrow(label, "node long, comp long")
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stash(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "least")
        # Large star: all greater neighbours of u point at the least around u.
        large = stash(both.join(least, both.a == least.u).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "large")
        # Small star: so do all smaller ones, and u.
        low = stash(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"), "low")
        small = large.join(low, large.a == low.u).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        e = stash(small, "edges")
        # Done when every node points at one other only, and none of those points further.
        if e.groupBy("a").count().filter("count > 1").isEmpty() and e.join(e.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
