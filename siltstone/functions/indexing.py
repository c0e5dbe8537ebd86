"""Dense numbering without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_index(df: DataFrame, order: Column, name: str = "idx", digits: int = 2) -> DataFrame:
    """``df`` numbered from 0 by ``order``, the hex digits of an md5 hash.

    The first ``digits`` are the bucket; buckets are ranked apart and shifted by
    running totals over the 16 ** digits of them, so no task ranks the whole table.
    """
    keyed = df.withColumn("_order", order).withColumn("_bucket", F.substring("_order", 1, digits))
    counts = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_order")) - 1
    return keyed.withColumn("_rank", rank).join(F.broadcast(offsets), "_bucket").withColumn(name, F.col("_offset") + F.col("_rank")).drop("_order", "_bucket", "_rank", "_offset")


def prime_from(n: int) -> int:
    """The least prime that is ``n`` or more."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n
