import hashlib
import json
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodemark import config
from lodemark.functions.hashing import _lanczos, _resampled, dhash64, hamming_hex64, hash_split, unit_interval
from lodemark.functions.text import class_of, jaccard_distance, normalize_caption, normalize_id, token_set, words
from lodemark.operators import ann, leakage, metrics, ordering, retrieval
from lodemark.operators.leakage import caption_overlap, gate, hamming_join, hard_matches, soft_matches
from lodemark.operators.retrieval import caption_table, exact_topk, hits_with_flags, materialize, near_pairs, query_table
from lodemark.schema import problems, to_manifest
from lodemark.sources import sinks
from lodemark.sources.annotations import alias_table, apply_splits, official_splits, parse_annotations


def value(spark, column, **given):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in given.items())).select(column.alias("v")).first()["v"]


def test_text(spark):
    assert value(spark, normalize_caption(F.col("x")), x="\t An Airport—Runway,  with_planes!\n") == "an airport runway with_planes"
    assert value(spark, normalize_caption(F.col("x"), compose=True), x="ﬁne Ⅳ") == "fine iv"
    assert value(spark, normalize_caption(F.lit(None).cast("string"))) == ""
    assert value(spark, F.size(words(F.col("x"))), x="  ") == 0
    assert value(spark, normalize_id(F.col("x")), x=r" a\b/c.d.jpg ") == "c.d"
    assert value(spark, class_of(F.col("x")), x="Images/airport/1.jpg") == "airport"
    assert value(spark, jaccard_distance(token_set(F.lit("")), token_set(F.lit("")))) == 0.0


def test_hashes(spark):
    assert value(spark, unit_interval(F.col("x"), 42), x="set::field/f_07.png") == int(hashlib.sha256(b"42::set::field/f_07.png").hexdigest()[:8], 16) / 2**32
    assert value(spark, hamming_hex64(F.lit("f" * 16), F.lit("0" * 16))) == 64
    assert value(spark, hamming_hex64(F.lit(""), F.lit("0" * 16))) == 64
    with pytest.raises(ValueError):
        hash_split(F.lit("a"), train=0.9)
    ramp = np.repeat(np.arange(90, dtype=np.uint8)[None, :, None], 80, 0).repeat(3, 2)
    assert dhash64(ramp) == "f" * 16 and dhash64(ramp[:, ::-1]) == "0" * 16


def test_band_join_is_lossless(spark):
    draw = np.random.default_rng(1)
    x = draw.integers(0, 1 << 63, 60)
    y = np.concatenate([x ^ (1 << int(draw.integers(63))) ^ (1 << int(draw.integers(63))) for _ in range(3)] + [draw.integers(0, 1 << 63, 60)])
    a, b = spark.createDataFrame([(i, int(v)) for i, v in enumerate(x)], "i int, ha long"), spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "j int, hb long")
    got = {(r["i"], r["j"], r["hamming"]) for r in hamming_join(a, b, 5).collect()}
    want = {(i, j, n) for i, u in enumerate(x) for j, v in enumerate(y) if (n := bin(int(u) ^ int(v)).count("1")) <= 5}
    assert got == want and len(got) >= 180


def records(spark, rows):
    return spark.createDataFrame(rows, "ordinal long, image_id string, relative_path string, image_path string, split string, captions array<string>, dhash64 string, sha256 string")


def test_leakage(spark):
    a = records(spark, [(0, "a1", "1", "", "test", ["Same"], "0" * 16, "s1"), (1, "a2", "2", "", "train", ["other", "x!"], "", "")])
    kb = records(spark, [(0, "k1", "1", "", "kb", ["Same", "Same"], "0" * 15 + "1", "s1"), (1, "k2", "2", "", "kb", ["X"], "f" * 16, ""), (2, "k3", "3", "", "kb", [], "0" * 16, "s1")])
    assert [(r["image_id"], r["kb_image_ids"]) for r in hard_matches(a, kb).collect()] == [("a1", ["k1", "k3"])]
    assert sorted((r["kb_image_id"], r["hamming"], r["already_hard_match"]) for r in soft_matches(a, kb).collect()) == [("k1", 1, True), ("k3", 0, True)]
    assert [tuple(r) for r in caption_overlap(a, kb).collect()] == [("Same", ["a1"], ["k1", "k1"])]
    assert sorted(r[0] for r in caption_overlap(a, kb, True).collect()) == ["same", "x"]
    assert gate({"hard_image_matches": 1}, {"hard_image_matches": True}) == ("FAIL", ["hard_image_matches"])


@pytest.mark.parametrize("per_bucket", [1, 7, 1000])
def test_order_over_several_buckets(spark, monkeypatch, tmp_path, per_bucket):
    monkeypatch.setattr(ordering, "BUCKET_ROWS", per_bucket)
    keys = [f"{'aBcD'[i % 4]}/{(i * 37) % 50:02d}.png" for i in range(100)] + ["", None]
    spark.createDataFrame([(k,) for k in keys], "url string").write.parquet(f"file://{tmp_path}/pages")
    rows = spark.read.parquet(f"file://{tmp_path}/pages").dropDuplicates(["url"])
    got = {r["url"]: r["ordinal"] for r in ordering.with_ordinal(rows, "url").select("url", "ordinal").collect()}
    assert got == {k: i for i, k in enumerate(sorted(set(keys), key=lambda k: ((k or "").lower(), k is not None, k or "")))}


def test_topk_is_stable(spark):
    draw = np.random.default_rng(12)
    x = np.rint(draw.normal(size=(90, 7)) * 3) + 0.5
    x[40:60] = x[3]
    q = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(x[:17])], "query_id string, embedding array<float>").repartition(3)
    kb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "kb_ordinal long, embedding array<float>").repartition(4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {f"q{i}": np.lexsort((np.arange(90), -np.round(u @ u[i], 12)))[:6].tolist() for i in range(17)}
    for batch, size in ((1, 1 << 20), (5, 7 * 8 * 11), (128, 56)):
        got = {}
        for r in exact_topk(q, kb, 6, batch, size).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["kb_ordinal"])
        assert got == want
    with pytest.raises(ValueError):
        exact_topk(q, kb, 91)


def test_search_is_dealt_over_a_grid(spark, monkeypatch):
    """Tasks are cells of bounded queries and vectors, whatever bytes they have: adaptive execution would put them together."""
    monkeypatch.setattr(retrieval, "LEAST_ROWS", 50)
    x = np.random.default_rng(2).normal(size=(600, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "query_id long, embedding array<double>")
    hits = exact_topk(rows, rows.withColumnRenamed("query_id", "kb_ordinal"), 5, block_bytes=200 * 64)
    assert re.search(r"hashpartitioning\(cell#\d+, 24\), REPARTITION_BY_NUM", hits._jdf.queryExecution().toString())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {(r["query_id"], r["rank"]): r["kb_ordinal"] for r in hits.collect()}
    assert all([got[q, r] for r in range(1, 6)] == np.argsort(-(u @ u[q]), kind="stable")[:5].tolist() for q in range(600))


@pytest.mark.parametrize("size", [600, 90])
def test_no_two_cells_meet_in_a_task(spark, monkeypatch, size):
    """By the hash of its number, a cell of 52 came to a task with three others."""

    def counted(*_):
        def run(batches):
            yield pd.DataFrame({"query_id": [len({c for pdf in batches for c in pdf["cell"]})], "kb_ordinal": [0], "similarity": [0.0]})

        return run

    monkeypatch.setattr(retrieval, "LEAST_ROWS", 50)
    monkeypatch.setattr(retrieval, "_multiply", counted)
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(600)], "query_id long, embedding array<double>")
    tasks = [r["query_id"] for r in exact_topk(rows, rows.withColumnRenamed("query_id", "kb_ordinal"), 60, block_bytes=size * 16).collect()]
    assert tasks == [1] * {600: 12, 90: 28}[size]


def test_caption_distance(spark):
    """Captions that are missing, null, empty, equal or there twice; queries with the same hits count as many as they are."""
    draw = np.random.default_rng(4)
    texts = [None, "", "--", "A b.", "a B", *(" ".join(f"w{i}" for i in draw.integers(0, 12, draw.integers(1, 9))) for _ in range(30))]
    captions = [*enumerate(texts), (7, "b w1 w2")]
    found = {q: draw.choice(38, int(draw.integers(1, 7)), replace=False).tolist() for q in range(40)}
    found |= {q: found[q % 3] for q in range(40, 70)}
    found[70] = found[1][::-1]
    hits = spark.createDataFrame([(q, r, c, 0.5) for q, ids in found.items() for r, c in enumerate(ids, 1)], "query_id long, rank int, kb_ordinal long, similarity double").repartition(5)
    kb = spark.createDataFrame(captions, "kb_ordinal long, caption string")
    words_of = lambda c: [set(re.sub(r"[^a-z0-9]+", " ", (t or "").lower()).split()) for i, t in captions if i == c] or [set()]
    want = {}
    for k in (1, 2, 5):
        means = []
        for ids in found.values():
            sets = [(r, w) for r, c in enumerate(ids[:k], 1) for w in words_of(c)]
            d = [1 - len(u & v) / len(u | v) if u | v else 0.0 for r, u in sets for s, v in sets if r < s]
            means += [sum(d) / len(d)] if d else []
        want[k] = sum(means) / len(means) if means else None
    rows = metrics.caption_distance(hits, kb, [1, 2, 5])
    assert {r["k"]: r["mean_caption_distance"] for r in rows.collect()} == pytest.approx(want)
    # no text is carried to a hit, and a pair's words are gone through once
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") == 1 and "array_union" not in plan
    assert plan.index("inline") > plan.index("Join LeftOuter, (kb_ordinal") < plan.index("split(")


def test_approximate_search_of_all_cells_is_exact(spark, monkeypatch):
    """Small batches, groups and cells in parts: no hit is lost among them."""
    monkeypatch.setattr(ann, "CELL_ROWS", 40)
    monkeypatch.setattr(ann, "ROUTED", 30)
    monkeypatch.setattr(ann, "BLOCK_BYTES", 100 * 64)
    x = np.random.default_rng(3).normal(size=(500, 8))
    x[100:180] = x[7]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "query_id long, embedding array<float>")
    centre, placed = ann.build(rows.withColumnRenamed("query_id", "kb_ordinal"), 9)
    want = sorted(map(tuple, exact_topk(rows, rows.withColumnRenamed("query_id", "kb_ordinal"), 6).drop("similarity").collect()))
    assert sorted(map(tuple, ann.search(centre, placed, rows, 6, 9).drop("similarity").collect())) == want


def test_results(spark):
    kb = records(spark, [(0, "k::harbour", "harbour", "", "kb", ["boats", "a pier", "boats"], "00ff00ff00ff00ff", "s"), (1, "k::wood", "wood", "", "kb", ["trees"], "", "t")])
    a = records(spark, [(0, "q7", "q7", "", "val", ["trees"], "00ff00ff00ff0cff", "u"), (1, "q8", "q8", "", "test", ["sea"], "", "v")])
    captions, queries = caption_table(kb), query_table(a)
    assert [r["caption_id"] for r in captions.orderBy("kb_ordinal").collect()] == [f"k::harbour::caption::0{i}" for i in range(3)] + ["k::wood::caption::00"]
    pairs = near_pairs(queries, captions, 2)
    hits = spark.createDataFrame([("q7", 1, 3, 0.7), ("q7", 2, 2, 0.6), ("q8", 1, 0, 0.5)], "query_id string, rank int, kb_ordinal long, similarity double")
    rows = {r["query_id"]: r for r in materialize(queries, hits_with_flags(hits, captions, pairs), pairs).collect()}
    assert rows["q7"]["flagged_kb_near_duplicate_count"] == 1 and [h["caption"] for h in rows["q7"]["retrieved"]] == ["trees", "boats"]
    assert [h["near_duplicate_hamming"] for h in rows["q7"]["retrieved"]] == [None, 2] and not rows["q8"]["has_any_flagged_kb_near_duplicate"]


def test_annotations(spark, tmp_path):
    rows = parse_annotations({"images": [{"id": 1, "file_name": "d/x.jpg"}, {"id": 2, "file_name": "y.jpg"}], "annotations": [{"image_id": 1, "caption": "a"}, {"image_id": 1, "caption": ""}, {"image_id": 1, "caption": "a"}]})
    assert rows == [("d/x.jpg", ["a", "a"], "")]
    assert parse_annotations({"x.jpg": "one", "y.jpg": ["a", "b"]}) == [("x.jpg", ["one"], ""), ("y.jpg", ["a", "b"], "")]
    assert parse_annotations({"x.jpg": "one"}, knowledge_base=True) == []
    assert parse_annotations([{"image": "z.png", "sentences": [{"raw": "r"}]}]) == [("z.png", ["r"], "")]
    with pytest.raises(ValueError):
        parse_annotations("text")
    table = {r["alias"]: r["captions"] for r in alias_table(spark, [("a/x.jpg", [" p "], ""), ("b/x.jpg", ["q"], "")]).collect()}
    assert table["x.jpg"] == table["x"] == ["p", "q"] and table["a/x.jpg"] == ["p"]
    named = [("p/quay.jpg", "Train"), ("dune.jpg", "restval"), ("fen.jpg", "TEST"), ("gone.jpg", "spare"), ("fen.jpg", "val")]
    (tmp_path / "dataset.json").write_text(json.dumps({"images": [{"file_name": k, "split": s} for k, s in named]}))
    found = official_splits(spark, f"file://{tmp_path}")
    assert found == [("p/quay.jpg", "train"), ("dune.jpg", "val"), ("fen.jpg", "test"), ("fen.jpg", "val")]
    out = apply_splits(spark.createDataFrame([("a::p/quay.jpg", "p/quay.jpg"), ("a::fen.jpg", "fen.jpg"), ("a::moor.jpg", "moor.jpg")], "image_id string, relative_path string"), found)
    assert {r["relative_path"]: (r["split_is_official"], r["split"]) for r in out.where("split_is_official").collect()} == {"p/quay.jpg": (True, "train"), "fen.jpg": (True, "val")} and out.count() == 3
    # a list at the top is no answer, nor is the key `image`; comments in text files are none either
    (tmp_path / "dataset.json").write_text(json.dumps([{"filename": "x.jpg", "split": "train"}]))
    assert official_splits(spark, f"file://{tmp_path}") is None
    (tmp_path / "dataset.json").write_text(json.dumps({"images": [{"image": "x.jpg", "split": "train"}]}))
    (tmp_path / "train.txt").write_text("# files\n\n d/x.jpg \n")
    assert official_splits(spark, f"file://{tmp_path}") == [("d/x.jpg", "train")]


def test_knowledge_base_annotations(spark):
    data = {"images": [{"id": 4, "filename": "p.tif", "class": "pond"}, {"id": 5, "filename": "r.tif", "category": "road"}, {"id": None, "filename": "s.tif"}], "annotations": [{"image_id": 5, "caption": "a road"}, {"image_id": 9, "caption": "none"}]}
    rows = parse_annotations(data, knowledge_base=True)
    assert rows == [("p.tif", [], "pond"), ("r.tif", ["a road"], "road")] and parse_annotations(data) == [("r.tif", ["a road"], "")]
    assert parse_annotations({"images": [], "annotations": []}) == [] and parse_annotations({"images": [{"filename": "z.tif", "captions": ["c"]}]}) == [("z.tif", ["c"], "")]
    with pytest.raises(ValueError):
        parse_annotations({"images": {"a": 1}}, knowledge_base=True)
    table = {r["alias"]: r for r in alias_table(spark, [("x/p.tif", ["one"], "first"), ("y/p.tif", [], "last"), ("p.tif", ["two"], "")], keep_empty=True).collect()}
    assert table["p"]["class_name"] == "last" and table["p"]["captions"] == ["one", "two"] and table["y/p.tif"]["captions"] == []


@pytest.mark.parametrize("threshold", [0, 2, 7, 8, 15, 16, 30])
def test_hamming_join_at_any_threshold(spark, threshold):
    draw = np.random.default_rng(threshold)
    x = np.concatenate((draw.integers(-(1 << 63), 1 << 63, 50), [0, 0, -1]))
    y = np.concatenate((x[:20] ^ (1 << draw.integers(0, 62, 20)), draw.integers(-(1 << 63), 1 << 63, 40), [0, 7]))
    a, b = spark.createDataFrame([*((i, int(v)) for i, v in enumerate(x)), (99, None)], "i int, ha long"), spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "j int, hb long")
    got = sorted((r["i"], r["j"], r["hamming"]) for r in hamming_join(a, b, threshold).collect())
    assert got == sorted((i, j, n) for i, u in enumerate(x) for j, v in enumerate(y) if (n := int(np.bitwise_count(np.uint64(int(u) & (1 << 64) - 1) ^ np.uint64(int(v) & (1 << 64) - 1)))) <= threshold)


def test_tiles_are_dealt_by_work(spark, monkeypatch):
    monkeypatch.setattr(leakage, "TASK_PAIRS", 1000)
    monkeypatch.setattr(leakage, "TILE", 16)
    x = np.random.default_rng(8).integers(-(1 << 63), 1 << 63, 300)
    rows = spark.createDataFrame([(i, int(v)) for i, v in enumerate(x)], "i int, ha long")
    got = hamming_join(rows, rows.select(F.col("i").alias("j"), F.col("ha").alias("hb")), 20)
    n = int(re.search(r"hashpartitioning\(.*?, (\d+)\), REPARTITION_BY_NUM", got._jdf.queryExecution().toString())[1])
    near = np.bitwise_count(x.view(np.uint64)[:, None] ^ x.view(np.uint64)[None, :]) <= 20
    assert n > 50 and sorted((r["i"], r["j"]) for r in got.collect()) == [*zip(*map(lambda a: a.tolist(), np.nonzero(near)))]


def test_fingerprint_resampling():
    """Weights add up, a flat image stays flat, and a step is where it was, for images above and below the size."""
    for n, m in ((100, 9), (9, 9), (5, 9), (1, 8), (640, 8)):
        w = _lanczos(n, m)
        assert w.shape == (m, n) and (np.abs(w.sum(axis=1) - (1 << 22)) <= n).all()
    assert (_resampled(np.full((7, 50), 200), 9) == 200).all()
    draw = np.random.default_rng(3)
    for h, w in ((64, 90), (33, 200), (300, 301)):
        g = draw.integers(0, 256, (h, w))
        # the published definition, sample by sample
        want = np.zeros((h, 9), np.int64)
        scale = w / 9
        for i in range(9):
            centre = (i + 0.5) * scale
            low, high = max(0, int(centre - 3 * scale + 0.5)), min(w, int(centre + 3 * scale + 0.5))
            k = []
            for x in range(low, high):
                t = (x - centre + 0.5) / scale
                k.append(0.0 if abs(t) >= 3 else 1.0 if t == 0 else 3 * np.sin(np.pi * t) * np.sin(np.pi * t / 3) / (np.pi * t) ** 2)
            whole = [int(0.5 + v / sum(k) * (1 << 22)) if v >= 0 else int(-0.5 + v / sum(k) * (1 << 22)) for v in k]
            for r in range(h):
                want[r, i] = min(255, max(0, ((1 << 21) + sum(int(g[r, low + j]) * v for j, v in enumerate(whole))) >> 22))
        assert np.abs(_resampled(g, 9) - want).max() <= 1 and (_resampled(g, 9) != want).mean() < 0.01


def test_manifest(spark):
    rows = to_manifest(spark.createDataFrame([("i", True, "")], "image_id string, ok boolean, sha256 string"))
    assert [r["problem"] for r in problems(rows).orderBy("problem_index").collect()] == ["ok_without_sha256", "ok_without_captions"]


def test_csv_keeps_white_space(spark, tmp_path):
    texts = ["plain", " lead", "trail ", "\ttab\t", "\nline", "line\n", "\r", "a\rb", "a\r\nb\r\n", "\x01z", " ", "", '"', '"q", "', "\\", '\\"', "#x", "null", "\u3000x\u00a0"]
    rows = spark.createDataFrame([(str(i), [t]) for i, t in enumerate(texts)], "image_id string, captions array<string>").repartition(3)
    sinks.write_csv(to_manifest(rows), f"file://{tmp_path}/m")
    got = {int(r["image_id"]): r["captions"] or "" for r in sinks.read_csv(spark, f"file://{tmp_path}/m").collect()}
    assert got == dict(enumerate(texts))


def test_config(tmp_path, monkeypatch):
    (tmp_path / "c.yaml").write_text("seed: 1\npaths: {a_root: x}\n")
    (tmp_path / "local.yaml").write_text("seed: 2\n")
    assert config.load(tmp_path / "c.yaml")["seed"] == 2
    monkeypatch.setenv("AUDIT_A_ROOT", "/env")
    assert config.load(tmp_path / "c.yaml")["paths"]["a_root"] == "/env"
    assert config.load(tmp_path / "c.yaml", {"a_root": "/arg"})["paths"]["a_root"] == "/arg"
