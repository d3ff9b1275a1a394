"""Sharding by longest processing time: groups of equal texts, the largest first, each to the
shard with the least bytes, taken from a heap.

Groups of one size are interchangeable, so the heap runs over the distinct group sizes and
their counts, which reach the driver as two arrays of numbers. Distinct sizes of n bytes in total
number at most sqrt(2 n): 14 million, 230 MB, for 100 TB in the worst case, tens of thousands in
practice; nothing that grows with the number of documents reaches the driver. The plan leaves it
as a table, written in parts. Long runs of one size are dealt at once by filling the
shards to a common level, which is what the heap would do. Groups learn their shard from
their rank among the groups of their size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.ranks import gapless
from factloom.llm.storage import materialize

#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Rows of the plan that are written at a time.
PLAN_ROWS = 500_000


def longest_first(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(size, [(shard, how many)]) for (size, count), which must come with the largest size first:
    each group to the least loaded shard, ties to the lower number."""
    heap = [(0, i) for i in range(shards)]
    for size, count in sizes:
        dealt: dict[int, int] = {}
        if count > 2 * shards and size > 0:
            loads = dict((i, load) for load, i in heap)

            def below(level: int, loads=loads, size=size) -> dict[int, int]:
                return {i: max(0, -(-(level - load) // size)) for i, load in loads.items()}

            low, high = 0, max(loads.values()) + size * count
            while low < high:
                level = (low + high + 1) // 2
                low, high = (level, high) if sum(below(level).values()) <= count else (low, level - 1)
            dealt = {i: n for i, n in below(low).items() if n}
            heap = [(loads[i] + size * dealt.get(i, 0), i) for i in loads]
            heapq.heapify(heap)
            count -= sum(dealt.values())
        for _ in range(count):
            load, i = heap[0]
            heapq.heapreplace(heap, (load + size, i))
            dealt[i] = dealt.get(i, 0) + 1
        yield size, sorted(dealt.items())


def _plan(spark: SparkSession, sizes: pa.Table, shards: int) -> DataFrame:
    """(size_of, first, stop, shard): which of the groups of a size, by their place, go where."""
    order = np.argsort(-sizes.column("weight").to_numpy(), kind="stable")
    weight, count = (sizes.column(c).to_numpy()[order] for c in ("weight", "n"))
    names, parts, held = ["size_of", "first", "stop", "shard"], [], ([], [], [], [])

    def put() -> None:
        made = pa.table([pa.array(c, t) for c, t in zip(held, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=names)
        parts.append(materialize(spark.createDataFrame(made), "plan"))
        for c in held:
            c.clear()

    for size, dealt in longest_first(zip(weight.tolist(), count.tolist(), strict=True), shards):
        first = 0
        for i, n in dealt:
            for c, x in zip(held, (size, first, first + n, i), strict=True):
                c.append(x)
            first += n
        if len(held[0]) >= PLAN_ROWS:
            put()
    put()
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``docs`` needs doc_id (long) and text; other columns are ignored. size is the UTF-8 length
    (null: none) plus ``ROW_BYTES``. Equal texts stay together, null texts likewise; a null
    and an empty text are two groups of the same size. The law is ``bytes``: shard sizes are
    as near equal as the groups allow, so a group larger than a fair share makes its shard
    larger. slot numbers the rows of a shard from 0 without gaps; grown_shard is null, as the
    law foresees no growth. Repeated rows each get a slot. Empty tables give empty results.
    """
    text = F.col("text").cast("string")
    bytes_ = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (bytes_ + ROW_BYTES).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.lit("null")).alias("print"),
    )
    rows = materialize(rows, "rows")
    groups = rows.groupBy(F.col("print").alias("group")).agg(F.sum("size").alias("weight"))
    groups = materialize(groups, "groups")
    sizes = groups.groupBy("weight").agg(F.count("*").alias("n")).toArrow()
    plan = _plan(docs.sparkSession, sizes, shards)
    plan = plan.groupBy("size_of").agg(F.collect_list(F.struct("first", "stop", "shard")).alias("runs"))  # a run a shard at most
    n_groups = int(sum(sizes.column("n").to_pylist()))
    ranked = gapless(groups, "weight", ["group"], "place", n_groups, sizes.num_rows)
    run = F.filter("runs", lambda r: (r["first"] <= F.col("place")) & (F.col("place") < r["stop"]))[0]
    placed = ranked.join(plan, ranked.weight == plan.size_of).select("group", run["shard"].alias("shard"))
    dealt = materialize(rows.join(placed, rows.print == placed.group).select("doc_id", "size", "text_crc32", "shard"), "dealt")
    out = gapless(dealt, "shard", ["doc_id", "text_crc32"], "slot", dealt.count(), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
