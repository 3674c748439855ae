"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix. DataFrame functions only.

The rows lie in source buckets (by a hash of a number that a written table holds, so a lost task finds the same rows again). For each bucket the exact number of
its rows that go to each shard is drawn: a multivariate hypergeometric row of the communication matrix, whose columns add
up to the exact shard sizes. Rows are permuted inside their bucket, dealt by the matrix, and permuted again in their shard.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodemark.llm.common import buckets_for, cut, scratch, session, with_prefix, write_text

SHARDS = 24
#: Rows of a bucket: what one task permutes.
BUCKET_ROWS = 50_000


def hypergeometric(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n drawn without replacement are among the good ones, for populations of any size.

    By inversion: the mass of every count within 40 standard deviations of the mean, from the ratios of neighbours; what
    lies beyond is less than a double can tell from nothing.
    """
    low, high = max(0, n - bad), min(n, good)
    if low >= high:
        return low
    total = good + bad
    mean = n * (good / total)
    spread = 40 * (mean * (bad / total) * ((total - n) / max(total - 1, 1))) ** 0.5 + 40
    low, high = max(low, int(mean - spread)), min(high, int(mean + spread) + 1)
    k = np.arange(low, high, dtype=float)
    steps = np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1))
    mass = np.concatenate(([0.0], np.cumsum(steps)))
    mass = np.cumsum(np.exp(mass - mass.max()))
    return low + int(np.searchsorted(mass, draw.random() * mass[-1], side="right"))


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """rows[p][s]: how many rows of bucket p go to shard s, as a uniform shuffle into shards of sizes at most one apart has it."""
    n = sum(counts)
    left = np.array([n // shards + (s < n % shards) for s in range(shards)], np.int64)
    draw = np.random.default_rng(seed)
    out = np.zeros((len(counts), shards), np.int64)
    for p, c in enumerate(counts):
        rest, later = c, int(left.sum())
        for s in range(shards):
            later -= int(left[s])
            out[p, s] = hypergeometric(draw, int(left[s]), later, rest)
            rest -= int(out[p, s])
        left -= out[p]
    return out


def _random(seed: int, *cols: str) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 42, bucket_rows: int = BUCKET_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size (UTF-8 bytes plus 8), text_crc32, law ("rows"), shard, slot, grown_shard (null).

    Shard counts differ by one at most and slots of a shard run from 0 without gaps. A null text counts as no bytes
    (size 8, crc32 0); texts of any length count whole. Every row is numbered once, in a written table, and dealt by its
    number, so null ids, ties and rows repeated any number of times are shuffled like all others.
    An empty table gives an empty one; other columns are not looked at.
    """
    spark = session(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32")), "sizes")
    n = base.count()
    parts = buckets_for(n, bucket_rows)
    rows = base.withColumn("p", F.pmod(_random(seed, "row"), F.lit(parts)).cast("int"))
    counts = {r["p"]: r["n"] for r in rows.groupBy("p").agg(F.count("*").alias("n")).toLocalIterator()}
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], shards, seed)
    path = scratch(spark, "matrix")
    write_text(spark, f"{path}/matrix.json", "\n".join(json.dumps({"p": p, "upto": row.tolist()}) for p, row in enumerate(matrix.cumsum(axis=1))))
    dealt = spark.read.schema("p int, upto array<long>").json(path)
    local = Window.partitionBy("p").orderBy(_random(seed + 1, "row"), "row")
    rows = rows.withColumn("r", F.row_number().over(local) - 1).join(dealt, "p")
    rows = rows.withColumn("shard", F.size(F.filter("upto", lambda c: c <= F.col("r")))).drop("upto")
    inner = buckets_for(n, shards * bucket_rows)
    again = _random(seed + 2, "row")
    rows = with_prefix(rows, ["shard"], [again, F.col("row")], F.pmod(again, F.lit(inner)).cast("int"), F.lit(1), "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    return shuffle_into_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
