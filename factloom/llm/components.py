"""Connected components: one block of edges contracted by numpy, or alternating large-star and
small-star steps in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.storage import discard, materialize

#: Edges that a task contracts together (16 bytes each, some ten times that while it does so).
BLOCK = 1 << 20


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.col("v").cast("decimal(38,0)"))).first()
    return tuple(row)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the same components: every node but the smallest of each component, with that one.

    Roots hook to smaller roots beside them, then paths are halved; two rounds leave at most
    half the roots of a component that still has several.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up
    more = root != np.arange(len(nodes))
    return nodes[more], nodes[root[more]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars in place of the edges of each block of ``BLOCK``."""
    held, n = [], 0

    def out():
        u, v = stars(*(np.concatenate([np.asarray(x[k]) for x in held]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            part = batch.slice(i, BLOCK)
            if held and n + part.num_rows > BLOCK:
                yield out()
                held, n = [], 0
            held.append([part.column(k).to_numpy() for k in (0, 1)])
            n += part.num_rows
    if held:
        yield out()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that an edge of ``edges`` (a, b: long) touches.

    The component is the smallest node that can be reached. Self loops and repeated edges
    are harmless; nodes of self loops alone are left out. Distinct edges that fit in one block
    are contracted in one task, and done. For more, each round is two aggregations
    with map-side combination and two joins on the node, which adaptive execution splits
    where a node has very many neighbours; no group is collected. The number of rounds grows
    with the logarithm of the diameter; the table of a round is deleted after the next. An empty
    input gives an empty result.
    """
    u, v = F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")
    now = materialize(edges.where("a <> b").select(u, v).distinct(), "cc")
    if (n := now.count()) <= BLOCK:
        if n:
            before, now = now, materialize(now.coalesce(1).mapInArrow(_contract, "u long, v long"), "cc")
            discard(before)
    else:
        now = _rounds(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _rounds(now: DataFrame) -> DataFrame:
    """Stars (u, v: the smaller) of whole components, written, from distinct edges."""
    seen = _digest(now)
    while True:
        # large star: every neighbour above u points to the smallest node around u
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            now.join(low, "u").select("u", F.col("m").alias("v"))
        ).where("u <> v").distinct()
        # small star: u and its lower neighbours point to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, now = now, materialize(small.where("u <> v").distinct(), "cc")
        discard(before)
        last, seen = seen, _digest(now)
        if last == seen:
            return now
