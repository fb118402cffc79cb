"""Connected components of a graph that is given by its edges.

First each task draws what it holds as stars. If no more than SMALL edges are left,
which is counted, one task can finish. Beyond that, each round every node points to its least neighbour, pointers are followed to their
ends by doubling, and the edges are drawn between the ends. Every node with a smaller
neighbour disappears, so the number of nodes at least halves: rounds are logarithmic,
whatever the shape. No node's neighbours are gathered; hot nodes are split by the joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, on_batches


#: Edges that one task takes; about 200 bytes each.
SMALL = 300_000


def gathered(edges: DataFrame) -> DataFrame:
    """edges(a, b) with each task's own components drawn as stars, so that less is left to do between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while up.setdefault(root, root) != root:
                root = up[root]
            while up[x] != root:
                up[x], x = root, up[x]
            return root

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
        found = np.array([(v, find(v)) for v in list(up)], dtype=np.int64).reshape(-1, 2)
        found = found[found[:, 0] != found[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return on_batches(edges.select("a", "b"), run, "a long, b long")


def ends(pointers: DataFrame) -> DataFrame:
    """(v, p) where p is what following (v, p) ends at; each step follows four pointers."""
    while True:
        two = pointers.alias("x").join(pointers.alias("y"), F.col("x.p") == F.col("y.v"), "left").select("x.v", F.coalesce("y.p", "x.p").alias("p"))
        four = two.alias("x").join(two.alias("y"), F.col("x.p") == F.col("y.v"), "left").select("x.v", F.coalesce("y.p", "x.p").alias("p"), (F.coalesce("y.p", "x.p") != F.col("x.p")).alias("moved"))
        step = cut(four)
        pointers = step.select("v", "p")
        if step.filter("moved").isEmpty():
            return pointers


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(v, p): for every node of edges(a, b), whose ids are whole numbers, the least node of its component."""
    left = cut(gathered(edges).distinct())
    if left.count() <= small:
        stars = gathered(left.coalesce(1))
        return cut(stars.select(F.col("a").alias("v"), F.col("b").alias("p")).unionByName(stars.select(F.col("b").alias("v"), F.col("b").alias("p")).distinct()))
    forest: DataFrame | None = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("p")))
        roots = ends(least)
        forest = roots if forest is None else cut(forest.alias("f").join(roots.alias("r"), F.col("f.p") == F.col("r.v"), "left").select("f.v", F.coalesce("r.p", "f.p").alias("p")))
        ra, rb = roots.select(F.col("v").alias("a"), F.col("p").alias("pa")), roots.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        left = cut(left.join(ra, "a").join(rb, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).filter("a <> b").distinct())
    return forest if forest is not None else left.select(F.col("a").alias("v"), F.col("b").alias("p"))
