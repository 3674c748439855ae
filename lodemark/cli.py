"""Command line: `python -m lodemark.cli audit|retrieve`."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from lodemark import config

PATHS = ("a_root", "kb_root", "processed_dir", "report_dir")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodemark")
    p.add_argument("command", choices=("audit", "retrieve"))
    p.add_argument("--config")
    for name in PATHS:
        p.add_argument("--" + name.replace("_", "-"))
    p.add_argument("--query-vectors", help="Parquet of query_id and embedding")
    p.add_argument("--caption-vectors", help="Parquet of caption_id and embedding")
    p.add_argument("--print-paths", action="store_true")
    p.add_argument("--print-summary", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    """0, or 2 if the audit's gate fails."""
    args = parser().parse_args(argv)
    cfg = config.load(args.config, {k: getattr(args, k) for k in PATHS}, overlay=args.command == "audit")
    if args.print_paths:
        print(json.dumps(config.describe(cfg), indent=2))
        return 0
    spark = SparkSession.builder.appName("lodemark").getOrCreate()
    if args.command == "audit":
        from lodemark.plans.audit import run_audit

        report = run_audit(spark, cfg)
        if args.print_summary:
            print(json.dumps({"gate": report["gate"], "leakage": report["leakage"]["counts"]}, indent=2))
        return 0 if report["gate"] == "PASS" else 2
    from lodemark.plans.retrieval import run_retrieval

    report = run_retrieval(spark, cfg, spark.read.parquet(args.query_vectors), spark.read.parquet(args.caption_vectors))
    if args.print_summary:
        print(json.dumps(report["by_k"], indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
