"""Positions in a total order without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET_ROWS = 100_000
SAMPLE = 1000


def prefix_sum(rows: DataFrame, bucket: Column, order: list[Column], weight: Column, name: str) -> DataFrame:
    """rows with `name`: the sum of weight over the rows before, by bucket and then by order.

    Buckets have to follow the order. A task sorts one bucket; the buckets' sums are a small table.
    """
    rows = rows.withColumn("_b", bucket).withColumn("_w", weight.cast("long"))
    sums = rows.groupBy("_b").agg(F.sum("_w").alias("_t"))
    sums = sums.withColumn("_base", F.sum("_t").over(Window.orderBy("_b")) - F.col("_t")).drop("_t")
    inside = Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_in", F.sum("_w").over(inside) - F.col("_w")).join(sums, "_b").withColumn(name, F.col("_base") + F.col("_in")).drop("_b", "_w", "_base", "_in")


def with_ordinal(rows: DataFrame, key: str, name: str = "ordinal") -> DataFrame:
    """rows with their place, from 0, by lower-cased key and then key.

    Buckets lie between at most SAMPLE keys, drawn by hash, so the same rows give the same buckets whenever a task runs again.
    """
    n = rows.count()
    count = min(SAMPLE, -(-n // BUCKET_ROWS))
    order = F.lower(F.coalesce(F.col(key), F.lit("")))
    bounds = []
    if count > 1:
        drawn = sorted(r[0] for r in rows.select(order.alias("k"), F.xxhash64(key).alias("h")).orderBy("h", "k").limit(SAMPLE).select("k").collect())
        bounds = [drawn[len(drawn) * i // count] for i in range(1, count)]
    return prefix_sum(rows, _bucket_of(order, bounds), [order, F.col(key)], F.lit(1), name)


def _bucket_of(value: Column, bounds: list, first: int = 0) -> Column:
    """How many of the sorted bounds are at most the value, by halves.

    A lambda over an array of bounds would do, but the optimiser carries its outer column to the wrong side of a join.
    """
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    return F.when(value < F.lit(bounds[half]), _bucket_of(value, bounds[:half], first)).otherwise(_bucket_of(value, bounds[half + 1 :], first + half + 1))
