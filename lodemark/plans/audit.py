"""The dataset audit: load both datasets, write manifests, check, compare, report."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemark.functions.text import class_of
from lodemark.operators import integrity, leakage
from lodemark.operators.ordering import with_ordinal
from lodemark.operators.sampling import smoke_sample
from lodemark.schema import to_manifest, validation
from lodemark.sources import sinks
from lodemark.sources.annotations import alias_table, apply_splits, official_splits, parse_annotations, with_captions, with_sidecars
from lodemark.sources.files import exists, find_first, first_root, inspect, read_text, scan_images


def _records(rows: DataFrame, cfg: dict, side: str, role: str, class_name) -> DataFrame:
    captioned = F.size("captions") > 0
    error = F.when(F.col("error") != "", F.col("error")).when(~captioned, "missing_captions").otherwise("")
    rows = rows.withColumn("class_name", class_name).withColumn("error", error).withColumn("ok", F.col("ok") & captioned)
    return rows.withColumn("schema_version", F.lit(cfg["schema_version"])).withColumn("source", F.lit(cfg[side]["source"])).withColumn("role", F.lit(role)).withColumn("image_id", F.concat(F.lit(cfg[side]["prefix"] + "::"), "relative_path"))


def _root(spark: SparkSession, root: str, skipped: str | None = "caption") -> str:
    """root, if it is there and has images below it; an error else."""
    if not exists(spark, root):
        raise FileNotFoundError(f"there is no folder {root}")
    if scan_images(spark, root, skipped=skipped, content=False).isEmpty():
        raise FileNotFoundError(f"there are no images under {root}")
    return root


def load_dataset(spark: SparkSession, cfg: dict) -> DataFrame:
    """Manifest rows of dataset A, splits applied: annotations, else sidecar texts; classes from folders."""
    root = _root(spark, cfg["paths"]["a_root"], cfg["a"]["skipped_folder"])
    images = inspect(spark, scan_images(spark, root, skipped=cfg["a"]["skipped_folder"]), root)
    path = find_first(spark, root, cfg["a"]["annotations"])
    entries = parse_annotations(json.loads(read_text(spark, path))) if path else []
    rows = with_sidecars(spark, with_captions(images, alias_table(spark, entries)), root)
    rows = _records(rows, cfg, "a", "caption_dataset", class_of(F.col("relative_path")))
    s = cfg["splits"]
    rows = apply_splits(rows, official_splits(spark, root) if s["prefer_official"] else None, cfg["seed"], s["train"], s["val"], s["test"])
    return to_manifest(rows)


def load_knowledge_base(spark: SparkSession, cfg: dict) -> DataFrame:
    """Manifest rows of the knowledge base; all of them are of split kb, classes are the annotation's."""
    root = _root(spark, cfg["paths"]["kb_root"], None)
    path = find_first(spark, root, cfg["kb"]["annotations"], ("", "annotations", "anno"))
    if not path:
        raise FileNotFoundError(f"no annotations under {root}; looked for {', '.join(cfg['kb']['annotations'])}")
    top = first_root(spark, root)
    images = inspect(spark, scan_images(spark, top, skipped=None, base=root), top)
    entries = parse_annotations(json.loads(read_text(spark, path)), knowledge_base=True)
    rows = with_captions(images, alias_table(spark, entries, keep_empty=True), knowledge_base=True)
    return to_manifest(_records(rows, cfg, "kb", "knowledge_base", F.col("annotated_class")).withColumn("split", F.lit("kb")))


def run_audit(spark: SparkSession, cfg: dict) -> dict:
    """Write both manifests, the reports and the sample page; return the report, whose gate is PASS or FAIL."""
    out, reports = cfg["paths"]["processed_dir"], Path(cfg["paths"]["report_dir"])
    report: dict = {"created": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "paths": cfg["paths"]}
    sides = {}
    for side, load in (("a", load_dataset), ("kb", load_knowledge_base)):
        sinks.write_jsonl(load(spark, cfg), f"{out}/{side}_manifest.jsonl")
        rows = sides[side] = sinks.read_manifest(spark, f"{out}/{side}_manifest.jsonl")
        sinks.write_csv(rows, f"{out}/{side}_manifest.csv")
        report[side] = {"validation": validation(rows), "integrity": integrity.report(rows)}
        sample = smoke_sample(rows, cfg["smoke"]["samples"], cfg["seed"]).collect()
        sinks.write_html(reports / f"{side}_samples.html", f"Samples of {side}", sinks.smoke_cards(sample))
    a, kb = (with_ordinal(sides[s], "relative_path") for s in ("a", "kb"))
    lk = cfg["leakage"]
    report["leakage"] = leakage.audit(a, kb, lk["threshold"], lk["exact_captions"], lk["normalized_captions"])
    report["gate"], report["failed"] = leakage.gate(report["leakage"]["counts"], cfg["gates"])
    sinks.write_json(reports / "leakage_audit.json", report["leakage"])
    sinks.write_json(reports / "audit.json", report)
    sinks.write_markdown(reports / "audit.md", "Dataset audit", {"Gate": report["gate"], "Leakage": report["leakage"]["counts"], "Warnings": report["leakage"]["warnings"], "A": report["a"]["integrity"], "Knowledge base": report["kb"]["integrity"]})
    return report
