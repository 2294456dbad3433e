"""Connected components of a graph whose edges and nodes stay distributed.

Alternating large-star and small-star steps: every node links its larger neighbours, then
its smaller ones, to the smallest node it sees. The minimum per node is an aggregate (with
partial sums on the map side) and a join, never a list, so a node with very many links is
no burden to one task. Partitions first reduce their edges to a forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

EDGE = "a long, b long"


def forest(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Each node of the given links, and the smallest node that links lead to from it."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (above := up.setdefault(top, top)) != top:
            top = above
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for x, y in pairs:
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(up)}


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition (a, b, neither null) as a forest."""
    roots: dict[int, int] = {}
    for batch in batches:
        new = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        roots = forest([*roots.items(), *new])
    links = [(x, y) for x, y in roots.items() if x != y]
    if links:
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())],
            ["a", "b"],
        )


def components(edges: DataFrame, contracted: bool = False) -> DataFrame:
    """``edges``: two columns of node ids. Returns (id, component) of every node with a link
    to another one; component is the smallest id that links lead to. Nulls, loops and
    repeated links change nothing; no link gives an empty result. ``contracted`` says that the edges
    come from a task that has called :func:`contract` itself: a second Python operator in one stage
    would give every executor twice the workers, which stay, each with its tables."""
    a, b = edges.columns
    links = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    links = links.filter("a is not null and b is not null and a != b")
    links = links if contracted else links.mapInArrow(contract, EDGE)
    links, seen = checkpointed(links.distinct()), None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
                links.select("b", "b").distinct()
            )
        seen = state
        links = checkpointed(_small_star(_large_star(links)))


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest among the node and its neighbours."""
    both = links.union(links.select("b", "a"))
    low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    low = links.groupBy("a").agg(F.min("b").alias("low"))
    others = links.join(low, "a").filter("b != low").select("b", "low")
    return low.union(others).toDF("a", "b").distinct()
