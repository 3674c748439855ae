"""The retrieval experiment over two manifests and their vectors."""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemark.operators import ann, metrics
from lodemark.operators.ordering import with_ordinal
from lodemark.operators.retrieval import caption_table, exact_topk, hits_with_flags, materialize, near_pairs, query_table
from lodemark.operators.sampling import stratified_ids
from lodemark.sources import sinks
from lodemark.sources.files import folder_bytes


def summarize(flagged: DataFrame, captions: DataFrame, queries: DataFrame, pairs: DataFrame, ks: list[int]) -> dict:
    """All metrics by k, as names and values."""
    out: dict = {"by_k": {k: {} for k in ks}, "sensitivity": {}}
    for df in (metrics.similarity_summary(flagged, ks), metrics.unique_source_ratio(flagged, ks), metrics.caption_distance(flagged, captions, ks, compose=True), metrics.flagged_queries(flagged, ks), metrics.contaminated_queries(flagged, queries, ks)):
        for r in df.collect():
            out["by_k"][r["k"]] |= {n: v for n, v in r.asDict().items() if n != "k"}
    out["sensitivity"] = {r["k"]: {n: v for n, v in r.asDict().items() if n != "k"} for r in metrics.sensitivity(flagged, queries, pairs, ks).collect()}
    out["near_pairs"] = {r["split"]: [r["pairs"], r["queries"]] for r in metrics.near_pair_counts(pairs).collect()}
    return out


def run_retrieval(spark: SparkSession, cfg: dict, query_vectors: DataFrame, caption_vectors: DataFrame) -> dict:
    """Search, flag, measure and report; query_vectors has query_id and embedding, caption_vectors caption_id and embedding.

    The encoder is whatever made the vectors. Manifests are those of the audit, whose leakage file has to be there.
    """
    out, reports, r = cfg["paths"]["processed_dir"], Path(cfg["paths"]["report_dir"]), cfg["retrieval"]
    if not (reports / "leakage_audit.json").exists():
        raise FileNotFoundError("the leakage audit has to run first")
    a, kb = (with_ordinal(sinks.read_manifest(spark, f"{out}/{s}_manifest.jsonl"), "relative_path") for s in ("a", "kb"))
    queries, captions = query_table(a), caption_table(kb)
    if queries.isEmpty() or captions.isEmpty():
        raise ValueError("there are no queries or no captions")
    vectors = caption_vectors.join(captions.select("caption_id", "kb_ordinal"), "caption_id").select("kb_ordinal", "embedding")
    began = time.perf_counter()
    sinks.write_vectors(exact_topk(query_vectors, vectors, max(r["ks"]), r["batch"]), f"{out}/hits")
    took = time.perf_counter() - began
    hits = spark.read.parquet(f"{out}/hits")
    sinks.write_vectors(near_pairs(queries, captions, cfg["leakage"]["threshold"]), f"{out}/near_pairs")
    pairs = spark.read.parquet(f"{out}/near_pairs")
    flagged = hits_with_flags(hits, captions, pairs)
    results = materialize(queries, flagged, pairs)
    sinks.write_jsonl(results, f"{out}/results.jsonl")
    n = queries.count()
    report = {"queries": n, "exact_search": {"total_s": took, "mean_ms": 1000 * took / n}, "spark": spark.version, "master": spark.sparkContext.master, **summarize(flagged, captions, queries, pairs, r["ks"])}
    if r["ann"]:
        began = time.perf_counter()
        centre, placed = ann.build(vectors, r["cells"], seed=cfg["seed"])
        sinks.write_vectors(placed, f"{out}/ann_cells")
        sinks.write_vectors(ann.centres_table(spark, centre), f"{out}/ann_centres")
        built = time.perf_counter() - began
        stored = ann.read_centres(spark.read.parquet(f"{out}/ann_centres"))
        began = time.perf_counter()
        sinks.write_vectors(ann.search(stored, spark.read.parquet(f"{out}/ann_cells"), query_vectors, max(r["ks"]), r["probes"]), f"{out}/ann_hits")
        searched = time.perf_counter() - began
        found = spark.read.parquet(f"{out}/ann_hits")
        report["ann_index"] = {"build_s": built, "search_s": searched, "mean_ms": 1000 * searched / n, "bytes": sum(folder_bytes(spark, f"{out}/{x}") for x in ("ann_cells", "ann_centres")), "cells": len(stored)}
        report["ann"] = {x["k"]: {m: x[m] for m in ("recall", "tie_aware_recall", "full_agreement")} for x in metrics.ann_recall(hits, found, r["ks"]).collect()}
    chosen = stratified_ids(queries, r["qualitative"], cfg["seed"])
    rows = results.where(F.col("query_id").isin(chosen)).orderBy("split", "query_id").collect()
    files = spark.read.format("binaryFile").load([x["query_image_path"] for x in rows]).select("path", "content").collect() if rows and all(x["query_image_path"] for x in rows) else []
    bytes_of = {f["path"].rpartition("/")[2]: bytes(f["content"]) for f in files}
    cards = [{"heading": x["query_id"], "image": sinks.thumbnail(bytes_of[b]) if (b := x["query_image_path"].rpartition("/")[2]) in bytes_of else None, "lines": [f"{h['rank']}. {h['similarity']:.4f} {h['caption']}" + (" (near pair)" if h["flagged_near_duplicate_pair"] else "") for h in x["retrieved"] or []]} for x in rows]
    sinks.write_html(reports / "qualitative.html", "Queries and what they retrieve", cards)
    sinks.write_json(reports / "retrieval.json", report, sort=False)
    sinks.write_markdown(reports / "retrieval.md", "Retrieval", {"Run": {k: report[k] for k in ("queries", "spark", "master")}, "Metrics": {f"{m} at {k}": v for k, ms in report["by_k"].items() for m, v in ms.items()}, "Approximate search": report.get("ann", {}), "Approximate index": report.get("ann_index", {})})
    return report
