"""Configuration: YAML with an overlay beside it, environment, then arguments; paths made absolute."""

from __future__ import annotations

import os
from collections.abc import Mapping
from pathlib import Path

DEFAULTS = {
    "seed": 42,
    "schema_version": "1.0.0",
    "paths": {"a_root": "data/a", "kb_root": "data/kb", "processed_dir": "data/processed", "report_dir": "reports"},
    "splits": {"prefer_official": True, "train": 0.7, "val": 0.15, "test": 0.15},
    "a": {"source": "a", "prefix": "a", "annotations": ["dataset.json", "captions.json"], "skipped_folder": "caption"},
    "kb": {"source": "kb", "prefix": "kb", "annotations": ["annotations.json", "dataset.json"]},
    "leakage": {"threshold": 5, "exact_captions": True, "normalized_captions": True},
    "gates": {"hard_image_matches": False, "hard_image_matches_test": False, "exact_caption_overlaps": False},
    "smoke": {"samples": 8},
    "retrieval": {"ks": [1, 3, 5, 10], "batch": 128, "ann": True, "cells": None, "probes": None, "qualitative": 12},
}
ENVIRONMENT = {"a_root": "AUDIT_A_ROOT", "kb_root": "AUDIT_KB_ROOT", "processed_dir": "AUDIT_PROCESSED_DIR", "report_dir": "AUDIT_REPORT_DIR"}


def merged(base: Mapping, over: Mapping) -> dict:
    """base with over laid on it, mapping by mapping."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def project_root(config: Path) -> Path:
    """AUDIT_PROJECT_ROOT; else the folder that holds a configs folder around the file; else the working folder."""
    if root := os.environ.get("AUDIT_PROJECT_ROOT"):
        return Path(root).resolve()
    return config.resolve().parent.parent if config.resolve().parent.name == "configs" else Path.cwd()


def load(path: str | Path | None = None, overrides: Mapping[str, str] | None = None, overlay: bool = True) -> dict:
    """Defaults, the file, local.yaml beside it, environment variables and overrides, each over those before."""
    out = DEFAULTS
    root = Path.cwd()
    if path:
        import yaml

        files = [Path(path), *([Path(path).parent / "local.yaml"] if overlay else [])]
        for f in files:
            if f.exists() or f == files[0]:
                data = yaml.safe_load(f.read_text(encoding="utf-8")) or {}
                if not isinstance(data, Mapping):
                    raise ValueError(f"{f} is not a mapping")
                out = merged(out, data)
        root = project_root(Path(path))
    paths = dict(out["paths"])
    paths |= {k: os.environ[v] for k, v in ENVIRONMENT.items() if os.environ.get(v)}
    paths |= {k: v for k, v in (overrides or {}).items() if v}
    remote = lambda p: "://" in str(p)
    paths = {k: str(v) if remote(v) else str((Path(v).expanduser() if Path(v).expanduser().is_absolute() else root / v).resolve()) for k, v in paths.items()}
    return merged(out, {"paths": paths, "project_root": str(root)})


def describe(cfg: Mapping) -> dict:
    """The paths in use and whether each is there (of those on this machine)."""
    return {k: {"path": v, "exists": Path(v).exists() if "://" not in v else None} for k, v in cfg["paths"].items()}
