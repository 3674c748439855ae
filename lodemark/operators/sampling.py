"""Samples that a seed fixes."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemark.functions.hashing import stable_rank
from lodemark.operators.ordering import BUCKET_ROWS, prefix_sum


def smoke_sample(rows: DataFrame, n: int, seed: int = 42, key: str = "image_id") -> DataFrame:
    """The n rows whose digests of seed and key come first (none for a negative n)."""
    ranked = rows.withColumn("stable_rank", stable_rank(F.col(key), seed))
    return ranked.orderBy("stable_rank", key).limit(max(n, 0))


def stratified_ids(rows: DataFrame, count: int, seed: int = 42, key: str = "query_id", order: str = "ordinal", splits: tuple[str, ...] = ("train", "val", "test")) -> list:
    """About count ids, as many of each split as of the others, those left over from the first splits.

    The draw is Python's, over positions in each split's order: only the chosen positions' ids come to the driver.
    """
    sizes = {r["split"]: r["n"] for r in rows.where(F.col("split").isin(*splits)).groupBy("split").agg(F.count("*").alias("n")).collect()}
    there = [s for s in splits if sizes.get(s)]
    draw, chosen = random.Random(seed), []
    for i, s in enumerate(there):
        quota = min(sizes[s], count // len(there) + (i < count % len(there)))
        places = draw.sample(range(sizes[s]), quota)
        at = prefix_sum(rows.where(F.col("split") == s), F.floor(F.col(order) / BUCKET_ROWS), [F.col(order)], F.lit(1), "_at")
        chosen += [(s, r[key]) for r in at.where(F.col("_at").isin(places)).select(key).collect()]
    return [k for _, k in sorted(chosen)]
