"""Retrieval metrics, for every k in one pass over the ranked hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemark.functions.text import jaccard_distance, normalize_caption, token_set


def _by_k(hits: DataFrame, ks: list[int]) -> DataFrame:
    """Each hit once for every k that its rank is within."""
    return hits.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k")


def similarity_summary(hits: DataFrame, ks: list[int]) -> DataFrame:
    """By k: mean_similarity, and of first hits top1_mean, top1_p05 and top1_p95 (exact, interpolated)."""
    top = F.when(F.col("rank") == 1, F.col("similarity"))
    return _by_k(hits, ks).groupBy("k").agg(F.avg("similarity").alias("mean_similarity"), F.avg(top).alias("top1_mean"), F.percentile(top, 0.05).alias("top1_p05"), F.percentile(top, 0.95).alias("top1_p95"))


def unique_source_ratio(hits: DataFrame, ks: list[int]) -> DataFrame:
    """By k: the mean over queries of distinct sources among k hits, divided by k."""
    per = _by_k(hits, ks).groupBy("query_id", "k").agg(F.count_distinct("source_image_id").alias("n"))
    return per.groupBy("k").agg(F.avg(F.col("n") / F.col("k")).alias("unique_source_ratio"))


def caption_distance(hits: DataFrame, captions: DataFrame, ks: list[int], compose: bool = False) -> DataFrame:
    """By k: the mean over queries of the mean token Jaccard distance of all pairs of k captions; null at 1.

    hits has query_id, rank and kb_ordinal, captions kb_ordinal and caption; a hit that captions lacks has an empty one.
    A caption's tokens are made once, not once for each hit, and queries with the same hits are compared once, as many as
    they are: a caption that all copies of a text find is joined to one list of them.
    """
    tokens = captions.select("kb_ordinal", token_set(normalize_caption(F.col("caption"), compose)).alias("t"))
    ids = F.array_sort(F.collect_list(F.struct("rank", "kb_ordinal"))).alias("ids")
    lists = hits.where(F.col("rank") <= max(ks)).groupBy("query_id").agg(ids).groupBy("ids").agg(F.min("query_id").alias("query_id"), F.count("*").alias("n"))
    found = lists.select("query_id", "n", F.inline("ids")).join(tokens, "kb_ordinal", "left")
    # at most as many hits as the largest k, so a list's pairs are made inside its row
    hit = F.struct("rank", F.coalesce("t", F.array().cast("array<string>")).alias("t"))
    rows = found.groupBy("query_id", "n").agg(F.array_sort(F.collect_list(hit)).alias("h"))
    later = lambda x: F.transform(F.filter("h", lambda y: y["rank"] < x["rank"]), lambda y: F.struct(x["rank"].alias("rank"), jaccard_distance(x["t"], y["t"]).alias("d")))
    pairs = rows.select("n", F.flatten(F.transform("h", later)).alias("p")).select("n", "p", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    near = F.transform(F.filter("p", lambda x: x["rank"] <= F.col("k")), lambda x: x["d"])
    per = pairs.select("k", "n", near.alias("d")).where(F.size("d") > 0).select("k", "n", (F.aggregate("d", F.lit(0.0), lambda s, x: s + x) / F.size("d")).alias("d"))
    mean = per.groupBy("k").agg((F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("mean_caption_distance"))
    every = hits.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ks))).alias("k"))
    return every.join(mean, "k", "left")


def flagged_queries(hits: DataFrame, ks: list[int]) -> DataFrame:
    """By k: queries with a flagged hit."""
    per = _by_k(hits, ks).groupBy("query_id", "k").agg(F.bool_or("flagged_near_duplicate_pair").alias("f"))
    return per.groupBy("k").agg(F.count_if("f").alias("queries_with_flagged_hit"))


def contaminated_queries(hits: DataFrame, queries: DataFrame, ks: list[int]) -> DataFrame:
    """By k: queries one of whose own captions is among the hits, word for word."""
    own = hits.join(queries.select("query_id", "reference_captions"), "query_id").withColumn("own", F.array_contains("reference_captions", F.col("caption")))
    per = _by_k(own, ks).groupBy("query_id", "k").agg(F.bool_or("own").alias("f"))
    return per.groupBy("k").agg(F.count_if("f").alias("queries_with_reference_string"))


def sensitivity(hits: DataFrame, queries: DataFrame, pairs: DataFrame, ks: list[int]) -> DataFrame:
    """By k, without the queries that have a near pair: excluded, remaining, mean_similarity and unique_source_ratio (null if none remain)."""
    near = pairs.select("query_id").distinct()
    rest = hits.join(near, "query_id", "left_anti")
    n = queries.select("query_id").distinct().join(near.withColumn("f", F.lit(True)), "query_id", "left").agg(F.count_if(F.col("f").isNotNull()).alias("excluded"), F.count_if(F.col("f").isNull()).alias("remaining"))
    every = n.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    mean = _by_k(rest, ks).groupBy("k").agg(F.avg("similarity").alias("mean_similarity"))
    return every.join(mean, "k", "left").join(unique_source_ratio(rest, ks), "k", "left").select("k", "excluded", "remaining", "mean_similarity", "unique_source_ratio")


def near_pair_counts(pairs: DataFrame) -> DataFrame:
    """By split: near pairs and the queries that have one."""
    return pairs.groupBy("split").agg(F.count("*").alias("pairs"), F.count_distinct("query_id").alias("queries"))


def ann_recall(exact: DataFrame, ann: DataFrame, ks: list[int], tolerance: float = 1e-6) -> DataFrame:
    """By k: recall of exact ids, recall that takes any id as near as the k-th exact one, and the share of queries with equal sets.

    exact and ann have query_id, rank, kb_ordinal and similarity; a query that ann lacks recalls nothing.
    """
    per = _by_k(exact, ks).groupBy("query_id", "k").agg(F.min("similarity").alias("edge"), F.collect_set("kb_ordinal").alias("e"))
    got = _by_k(ann, ks).join(per.select("query_id", "k", "edge"), ["query_id", "k"]).groupBy("query_id", "k").agg(F.collect_set("kb_ordinal").alias("a"), F.count_if(F.col("similarity") >= F.col("edge") - tolerance).alias("t"))
    both = per.join(got, ["query_id", "k"], "left")
    recall = F.coalesce(F.size(F.array_intersect("e", "a")), F.lit(0)) / F.col("k")
    return both.groupBy("k").agg(F.avg(recall).alias("recall"), F.avg(F.coalesce("t", F.lit(0)) / F.col("k")).alias("tie_aware_recall"), F.avg((recall == 1).cast("double")).alias("full_agreement"))
