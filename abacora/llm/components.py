"""Connected components by alternating large and small stars, a written table per round."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, lean, materialize


def spanning(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the same components: of each Arrow batch every node with its smallest one, so many links among the same nodes become few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while (y := root.setdefault(x, x)) != x:
                    root[x] = root[y]
                    x = y
                return x

            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(u), find(v)
                if a != b:
                    root[max(a, b)] = min(a, b)
            kept = [(x, find(x)) for x in root if find(x) != x]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.int64()), pa.array([y for _, y in kept], pa.int64())], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(lean(run), "u long, v long")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (its smallest node) of every node of edges (u, v); both are longs.

    Each round links nodes to the smallest neighbour they know, first from larger neighbours, then
    from smaller ones; rounds grow with the logarithm of the longest path. Groups are reduced to
    their minimum before they are joined back, so a node with very many links is no single task.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    e, seen = materialize(e, "cc"), None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        large = both.filter("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        near = large.join(low, F.col("u") == F.col("k"))
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
        old, e = e, materialize(small, "cc")
        discard(old)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == seen or not now["n"]:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
