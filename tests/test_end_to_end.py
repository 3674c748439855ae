import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PythonException

from lodemark import config
from lodemark.operators.encoding import encode
from lodemark.plans.audit import load_dataset, load_knowledge_base, run_audit
from lodemark.plans.retrieval import run_retrieval
from lodemark.sources.files import decoded_images


def png(path, seed):
    x = np.random.default_rng(seed).integers(0, 255, (32, 32, 3), dtype=np.uint8)
    raw = b"".join(b"\0" + row.tobytes() for row in x)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 32, 32, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_missing_input(spark, tmp_path):
    cfg = config.merged(config.DEFAULTS, {"paths": {"a_root": f"file://{tmp_path}/none", "kb_root": f"file://{tmp_path}/kb"}})
    with pytest.raises(FileNotFoundError):
        load_dataset(spark, cfg)
    png(tmp_path / "kb/images/x.png", 1)
    with pytest.raises(FileNotFoundError):
        load_knowledge_base(spark, cfg)
    (tmp_path / "none/Caption").mkdir(parents=True)
    png(tmp_path / "none/Caption/x.png", 1)
    with pytest.raises(FileNotFoundError):
        load_dataset(spark, cfg)


def test_encode_images(spark, tmp_path):
    for k in range(5):
        png(tmp_path / f"d/{k}.png", k)
    (tmp_path / "d/broken.png").write_bytes(b"none")
    images = decoded_images(spark, f"file://{tmp_path}")

    def load(columns=4):
        return lambda found: np.array([np.frombuffer(x["data"], np.uint8).reshape(x["height"], x["width"], x["nChannels"])[0, :columns, 2] + 1.0 for x in found])

    got = {r["image_path"].rpartition("/")[2]: r["embedding"] for r in encode(images, "image_path", "image", load, 4, batch=2).collect()}
    for k in range(5):
        row = np.random.default_rng(k).integers(0, 255, (32, 32, 3), dtype=np.uint8)[0, :4, 0] + 1.0
        assert np.allclose(got[f"{k}.png"], row / np.linalg.norm(row), atol=1e-6)
    assert len(got) == 5
    with pytest.raises(PythonException):
        encode(images, "image_path", "image", load, 5).collect()


def test_audit_and_retrieval(spark, tmp_path):
    a, kb = tmp_path / "a", tmp_path / "kb"
    for k, name in enumerate(("harbor/h1", "beach/b1", "beach/b2")):
        png(a / "images" / f"{name}.png", k)
    (a / "images/beach/b2.txt").write_text("a line\n\na line\nanother\n")
    (a / "images/beach/broken.PNG").write_bytes(b"no image")
    (a / "dataset.json").write_text(json.dumps({"images": [{"filename": "h1.png", "split": "test", "sentences": [{"raw": "Ships here."}]}, {"filename": "b1.png", "split": "train", "sentences": [{"raw": "sand"}]}]}))
    png(kb / "images/copy.png", 0)
    png(kb / "images/own.png", 9)
    (kb / "annotations").mkdir()
    (kb / "annotations/annotations.json").write_text(json.dumps({"images": [{"filename": "copy.png", "class": "port", "captions": ["ships here"]}, {"filename": "own.png", "captions": ["a wood", "sand"]}]}))
    cfg = config.merged(config.DEFAULTS, {"paths": {"a_root": f"file://{a}", "kb_root": f"file://{kb}", "processed_dir": f"file://{tmp_path}/out", "report_dir": str(tmp_path / "reports")}, "gates": {"hard_image_matches_test": True}, "retrieval": {"ks": [1, 2], "cells": 2, "probes": 2}})
    report = run_audit(spark, cfg)
    counts = report["leakage"]["counts"]
    assert report["gate"] == "FAIL" and counts["hard_image_matches_test"] == 1 and counts["soft_image_matches"] >= 1
    kb_rows = {r["relative_path"]: r for r in spark.read.json(str(tmp_path / "out/kb_manifest.jsonl")).collect()}
    assert kb_rows["images/copy.png"]["class_name"] == "port" and kb_rows["images/copy.png"]["image_id"] == "kb::images/copy.png"
    broken = [r for r in spark.read.json(str(tmp_path / "out/a_manifest.jsonl")).collect() if not r["ok"]]
    assert [r["error"].partition(":")[0] for r in broken] == ["UnidentifiedImageError"] and broken[0]["error"].endswith(f"'{a}/images/beach/broken.PNG'") and broken[0]["sha256"]
    assert counts["exact_caption_overlaps"] == 1 and counts["normalized_caption_overlaps"] == 2
    assert report["a"]["integrity"]["n_records"] == 4 and report["a"]["integrity"]["n_ok"] == 3 and report["a"]["integrity"]["n_captions"] == 4
    queries = spark.createDataFrame([(f"a::images/{n}.png", [1.0, float(i)]) for i, n in enumerate(("harbor/h1", "beach/b1", "beach/b2"))], "query_id string, embedding array<float>")
    captions = spark.createDataFrame([("kb::images/copy.png::caption::00", [1.0, 0.0]), ("kb::images/own.png::caption::00", [0.0, 1.0]), ("kb::images/own.png::caption::01", [1.0, 1.0])], "caption_id string, embedding array<float>")
    out = run_retrieval(spark, cfg, queries, captions)
    assert out["by_k"][1]["mean_similarity"] > 0.9 and out["ann"][2]["recall"] == 1.0 and out["ann_index"]["cells"] == 2 and out["ann_index"]["bytes"] > 0 and out["by_k"][2]["queries_with_reference_string"] == 1
    assert (tmp_path / "reports/qualitative.html").exists()
