"""Gapless numbering within groups, in tasks of bounded share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that one task numbers, about, and buckets at least; buckets are counted from these.
BUCKET_ROWS, LEAST_BUCKETS = 50_000, 64
#: Bucket sizes that are broadcast at most, 24 bytes each; more of them are joined by a shuffle.
SENT_SIZES = 200_000


def gapless(df: DataFrame, by: str, ids: list[str], out: str, rows: int, values: int) -> DataFrame:
    """Add ``out``: 0, 1, ... within each value of ``by``, every number once.

    A group is dealt over buckets by a hash of ``ids`` and ``by``, numbered there, and shifted by
    the sizes of the buckets before, so a group with a third of all rows is no single task. There
    are as many buckets as ``rows``, the number of rows of ``df``, needs for ``BUCKET_ROWS`` each
    if one group held them all, and ``LEAST_BUCKETS`` at least. ``values`` is the number of values of ``by`` or a bound of it. Rows
    that agree in ``ids`` are told apart by the order in which they come, so they must be alike.
    ``df`` is read twice and must give the same rows both times. Columns starting with ``_rank``
    must not exist.
    """
    buckets = max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))
    df = df.withColumn("_rank_bucket", F.pmod(F.xxhash64(*ids), F.lit(buckets)))
    sizes = df.groupBy(by, "_rank_bucket").agg(F.count("*").alias("_rank_n"))
    before = Window.partitionBy(by).orderBy("_rank_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(by).alias("_rank_by"), F.col("_rank_bucket").alias("_rank_in"), F.coalesce(F.sum("_rank_n").over(before), F.lit(0)).alias("_rank_shift"))
    place = F.row_number().over(Window.partitionBy(by, "_rank_bucket").orderBy(*ids)) - 1
    df = df.withColumn("_rank_place", place)
    on = (df[by] == F.col("_rank_by")) & (df["_rank_bucket"] == F.col("_rank_in"))
    joined = df.join(F.broadcast(sizes) if values * buckets <= SENT_SIZES else sizes, on)
    return joined.withColumn(out, (F.col("_rank_place") + F.col("_rank_shift")).cast("long")).drop("_rank_by", "_rank_in", "_rank_bucket", "_rank_shift", "_rank_place")
