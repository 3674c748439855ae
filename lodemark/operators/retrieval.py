"""Exact cosine retrieval of captions for queries, and the results with their leakage flags."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodemark.functions.hashing import hex_to_long
from lodemark.functions.text import caption_id
from lodemark.operators.leakage import hamming_join
from lodemark.operators.ordering import BUCKET_ROWS, prefix_sum

#: Bytes of knowledge-base vectors (as doubles) that are one block, and vectors that are packed into one value at most.
BLOCK_BYTES, PACK_ROWS = 32 << 20, 1024
#: Queries that meet a block in one task, at most and at least if that makes CELLS tasks.
QUERY_ROWS, LEAST_ROWS, CELLS = 16_384, 256, 24
#: Vectors that are multiplied at once, pairs, and vectors that a task holds until it packs them all.
TILE, PAIRS, HELD_ROWS = 8192, 1 << 16, 1 << 16


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """A unit vector of doubles; a zero or non-finite vector is an error."""
    n = norm(v)
    return F.when((n > 0) & (n < float("inf")), F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.raise_error(F.lit("a zero or non-finite vector can't be normalised")))


def caption_table(kb: DataFrame) -> DataFrame:
    """One row per caption of the knowledge base, numbered in manifest order (kb has ordinal)."""
    numbered = prefix_sum(kb, F.floor(F.col("ordinal") / BUCKET_ROWS), [F.col("ordinal")], F.size("captions"), "_first")
    out = numbered.select("_first", F.col("image_id").alias("source_image_id"), F.col("relative_path").alias("source_relative_path"), F.col("dhash64").alias("source_image_dhash64"), F.col("sha256").alias("source_image_sha256"), F.posexplode("captions").alias("caption_index", "caption"))
    out = out.withColumn("caption_id", caption_id(F.col("source_image_id"), F.col("caption_index")))
    return out.withColumn("kb_ordinal", F.col("_first") + F.col("caption_index")).drop("_first")


def query_table(a: DataFrame) -> DataFrame:
    return a.select("ordinal", F.col("image_id").alias("query_id"), F.col("relative_path").alias("query_relative_path"), F.col("image_path").alias("query_image_path"), "split", F.col("captions").alias("reference_captions"), F.col("dhash64").alias("query_dhash64"), F.col("sha256").alias("query_sha256"))


def _unit(column) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in column])
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    if not np.isfinite(length).all() or (length == 0).any():
        raise ValueError("a zero or non-finite vector can't be normalised")
    return x / length


def _packed(rows: DataFrame, key: str, d: int, ids: str) -> DataFrame:
    """rows (key, embedding, g) as g, ids (array) and data: PACK_ROWS vectors at most of one g, as they are. No shuffle: a task packs what it has."""
    kind, real = rows.schema[key].dataType.simpleString(), _real(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = {}, 0
        for pdf in batches:
            if not len(pdf):
                continue
            if count > HELD_ROWS:
                for g in [*held]:
                    yield one(g, *held.pop(g))
                count = 0
            count += len(pdf)
            x = np.stack([np.asarray(v, real) for v in pdf["embedding"]])
            if x.shape[1] != d:
                raise ValueError(f"a vector of {x.shape[1]} dimensions, not {d}")
            _unit(x)
            for g, at in pdf.groupby("g", sort=False).indices.items():
                names, parts = held.setdefault(g, ([], []))
                names.extend(pdf[key].iloc[at].tolist())
                parts.append(x[at])
                if len(names) >= PACK_ROWS:
                    yield one(g, *held.pop(g))
        for g in [*held]:
            yield one(g, *held.pop(g))

    def one(g: int, names: list, parts: list) -> pd.DataFrame:
        return pd.DataFrame({"g": [g], ids: [names], "data": [np.concatenate(parts).tobytes()]})

    return rows.select(key, "embedding", F.col("g").cast("int").alias("g")).mapInPandas(run, f"g int, {ids} array<{kind}>, data binary")


def _real(rows: DataFrame):
    return np.float32 if rows.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64


class Best:
    """The k best of each of n queries so far: of equal scores those with the smallest ids."""

    def __init__(self, n: int, k: int):
        self.k, self.edge = k, np.full(n, -np.inf)
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        row, ids, score = np.concatenate((self.row, row)), np.concatenate((self.id, ids)), np.concatenate((self.score, score))
        order = np.lexsort((ids, -score, row))
        row = row[order]
        first = np.searchsorted(row, row)
        place = np.arange(len(row)) - first
        there = place < self.k
        self.row, self.id, self.score = row[there], ids[order][there], score[order][there]
        full = place[there] == self.k - 1
        self.edge[self.row[full]] = self.score[full]


def _pairs(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of rows i of left and j of right, each the same wherever its pair comes up: equal vectors are ties."""
    parts = [(left[i[at : at + PAIRS]] * right[j[at : at + PAIRS]]).sum(axis=1) for at in range(0, len(i), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _every(k: int, batch: int):
    """Hits of a block of queries among all vectors of a block: float32 products say which pairs are worth exact ones."""

    def hits(left: np.ndarray, right: np.ndarray, ids: np.ndarray, g: np.ndarray, known: dict) -> Iterator[tuple]:
        slack = (left.shape[1] + 8) * 2.0**-23
        if "right" not in known:
            known["right"] = right.astype(np.float32)
        for at in range(0, len(left), batch):
            part = left[at : at + batch]
            small, best = part.astype(np.float32), Best(len(part), k)
            for a in range(0, len(right), TILE):
                s = small @ known["right"][a : a + TILE].T
                least = best.edge
                if s.shape[1] > k and np.isinf(least).any():
                    least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - slack)
                i, j = np.nonzero(s >= (least - slack).astype(np.float32)[:, None])
                if len(i):
                    best.add(i, ids[a + j], _pairs(part, right, i, a + j))
            yield best.row + at, best.id, best.score

    return hits


def _multiply(d: int, q_real, k_real, hits):
    """Blocks of a cell, vectors before queries, to hits. hits gets unit vectors, ids and each vector's group, and keeps what it likes in `known`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, known = None, [], {}
        for pdf in batches:
            for cell, g, q_ids, k_ids, data in zip(pdf["cell"], pdf["g"], pdf["q_ids"], pdf["k_ids"], pdf["data"]):
                if cell != now:
                    now, held, known = cell, [], {}
                if k_ids is not None:
                    held.append((_unit(np.frombuffer(data, k_real).reshape(-1, d)), np.asarray(k_ids, np.int64), np.full(len(k_ids), g)))
                elif held:
                    if len(held) > 1:
                        held = [tuple(map(np.concatenate, zip(*held)))]
                    names = np.asarray(q_ids)
                    for row, ids, score in hits(_unit(np.frombuffer(data, q_real).reshape(-1, d)), *held[0], known):
                        yield pd.DataFrame({"query_id": names[row], "kb_ordinal": ids, "similarity": score})

    return run


def _apart(spark: SparkSession, n: int) -> Column:
    """n ints, as an array, that a shuffle by hash over n partitions puts into one each; by themselves 0 to n - 1 would share some."""
    tried, firsts = 16 * n, []
    while len(firsts) < n:
        tried *= 2
        ids = spark.range(tried).select(F.col("id").cast("int").alias("i"))
        firsts = [r["i"] for r in ids.groupBy(F.pmod(F.hash("i"), F.lit(n))).agg(F.min("i").alias("i")).collect()]
    return F.split(F.lit(",".join(map(str, sorted(firsts)))), ",").cast("array<int>")


def met(queries: DataFrame, kb: DataFrame, n: int, d: int, k: int, block_bytes: int, hits, groups: Column | None = None) -> DataFrame:
    """The k best hits: every block of queries meets every block of kb in a task of its own, a cell of a grid.

    A cell has about block_bytes of vectors and QUERY_ROWS queries at most, and there are CELLS cells if there are queries
    enough, so no task grows with the tables; only their number does. kb's rows are dealt over blocks by `groups` (a
    number of the group that stays together), else by id. Cells are dealt by number, as they hold few bytes for their
    work and would be put together by their bytes, and their names are such that no two hash to one task. Of a query and
    cell k hits at most come out.
    """
    key = queries.schema["query_id"].dataType.simpleString()
    asked = queries.count()
    down = max(1, -(-n * d * 8 // block_bytes))
    across = max(1, -(-asked // QUERY_ROWS), min(-(-asked // LEAST_ROWS), -(-CELLS // down)))
    places = lambda count: F.sequence(F.lit(0), F.lit(count - 1))
    names = _apart(kb.sparkSession, across * down)
    cell = lambda i, j: F.get(names, (i * down + j).cast("int")).alias("cell")
    group, block = (F.pmod(F.xxhash64("kb_ordinal"), F.lit(down)), F.col("g")) if groups is None else (groups, F.pmod(F.xxhash64("g"), F.lit(down)))
    left = _packed(queries.withColumn("g", F.pmod(F.xxhash64("query_id"), F.lit(across))), "query_id", d, "q_ids")
    right = _packed(kb.withColumn("g", group), "kb_ordinal", d, "k_ids")
    left = left.withColumn("_o", F.explode(places(down))).select(cell(F.col("g"), F.col("_o")), F.lit(1).alias("side"), "g", "q_ids", F.lit(None).cast("array<bigint>").alias("k_ids"), "data")
    right = right.withColumn("_o", F.explode(places(across))).select(cell(F.col("_o"), block), F.lit(0).alias("side"), "g", F.lit(None).cast(f"array<{key}>").alias("q_ids"), "k_ids", "data")
    cells = left.union(right).repartition(across * down, "cell").sortWithinPartitions("cell", "side")
    found = cells.select("cell", "g", "q_ids", "k_ids", "data").mapInPandas(_multiply(d, _real(queries), _real(kb), hits), f"query_id {key}, kb_ordinal long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "kb_ordinal"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "kb_ordinal", "similarity")


def exact_topk(queries: DataFrame, kb: DataFrame, k: int, batch: int = 128, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k captions of largest cosine for each query: query_id, rank, kb_ordinal, similarity; ties to the smaller ordinal.

    queries has query_id and embedding, kb kb_ordinal and embedding. Both are packed into blocks of vectors where they lie;
    block meets block in a task of its own (see `met`) and is multiplied in numpy, and only k hits of a query and block are
    shuffled. Nothing comes to the driver but counts. The result doesn't depend on block, batch or partitions. An error
    unless 1 <= k <= rows of kb.
    """
    size = kb.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d"), F.min(F.size("embedding")).alias("e")).first()
    if not 1 <= k <= size["n"]:
        raise ValueError(f"k is {k}; the knowledge base has {size['n']} rows")
    if size["d"] != size["e"]:
        raise ValueError("vectors of the knowledge base differ in dimension")
    return met(queries.select("query_id", "embedding"), kb.select("kb_ordinal", "embedding"), size["n"], size["d"], k, block_bytes, _every(k, batch))


def near_pairs(queries: DataFrame, captions: DataFrame, threshold: int = 5) -> DataFrame:
    """query_id, source_image_id, hamming: fingerprints within the threshold, one of each source image that has a caption."""
    first = captions.groupBy("source_image_id").agg(F.min_by("source_image_dhash64", "kb_ordinal").alias("d"))
    return hamming_join(queries.select("query_id", "split", hex_to_long(F.col("query_dhash64")).alias("ha")), first.select("source_image_id", hex_to_long(F.col("d")).alias("hb")), threshold).select("query_id", "split", "source_image_id", "hamming")


def hits_with_flags(hits: DataFrame, captions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Hits with what is known of their caption, whether query and source are a near pair, and how near."""
    near = pairs.select("query_id", "source_image_id", F.col("hamming").alias("near_duplicate_hamming"))
    return hits.join(captions.drop("source_image_dhash64", "source_image_sha256", "caption_index"), "kb_ordinal").join(near, ["query_id", "source_image_id"], "left").withColumn("flagged_near_duplicate_pair", F.col("near_duplicate_hamming").isNotNull())


def materialize(queries: DataFrame, flagged: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per query: what is known of it, its near pairs, and its hits in order; nothing is filtered out."""
    hit = F.struct("rank", "caption_id", "source_image_id", "source_relative_path", "caption", "similarity", "flagged_near_duplicate_pair", "near_duplicate_hamming")
    lists = flagged.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("retrieved"))
    counts = pairs.groupBy("query_id").agg(F.count("*").cast("int").alias("n"))
    out = queries.join(counts, "query_id", "left").join(lists, "query_id", "left")
    return out.withColumn("has_any_flagged_kb_near_duplicate", F.col("n").isNotNull()).withColumn("flagged_kb_near_duplicate_count", F.coalesce("n", F.lit(0))).drop("n", "ordinal")
