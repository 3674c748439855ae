"""The registered audit and retrieval queries, and the same in DuckDB SQL.

The synthetic tables stand in for images: a document is an image, its text the file's bytes and its lines the captions;
sources with an even number are dataset A, the others the knowledge base. A vector's sign bits are its fingerprint, its
label its source. Vectors search all vectors. Scores are rounded to six places, as sums of doubles differ in their last.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemark.functions.hashing import hamming_hex64, hash_split, unit_interval
from lodemark.functions.text import basename, caption_id, class_of, normalize_caption, normalize_id, stem, token_set
from lodemark.operators import ann, integrity, leakage, metrics, sampling
from lodemark.operators.ordering import with_ordinal
from lodemark.operators.retrieval import caption_table, exact_topk, hits_with_flags, l2_normalize, materialize, near_pairs, query_table
from lodemark.schema import problems, to_manifest, validation
from lodemark.sources import sinks
from lodemark.sources.annotations import alias_table, apply_splits, official_splits, parse_annotations, with_captions
from lodemark.sources.files import scratch_folder, write_file

KS = [1, 3, 5, 10]
NEAR = 20


def _documents(spark: SparkSession, d: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return spark.read.parquet(f"{d}/documents.parquet").select(
        F.col("doc_id").alias("ordinal"), F.col("doc_id").cast("string").alias("image_id"), F.col("doc_id").cast("string").alias("relative_path"), F.lit("").alias("dhash64"),
        F.sha2("text", 256).alias("sha256"), F.coalesce(lines, F.array().cast("array<string>")).alias("captions"), "source", hash_split(F.col("doc_id").cast("string")).alias("split"),
    )


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _documents(spark, d)
    even = F.regexp_extract("source", r"(\d+)", 1).cast("int") % 2 == 0
    return docs.where(even), docs.where(~even)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("kb_ordinal"), "embedding", F.col("label").cast("long").alias("source_image_id"))


def _bits(v: Column) -> Column:
    return F.aggregate(v, F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))


def _first_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first line of a document, the caption of the vector of its number."""
    return _documents(spark, d).select(F.col("ordinal").alias("kb_ordinal"), F.coalesce(F.get("captions", F.lit(0)), F.lit("")).alias("caption"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's ten nearest, with label and the first line of the document of that number as caption."""
    v = _vectors(spark, d)
    hits = exact_topk(v.select("query_id", "embedding"), v.select("kb_ordinal", "embedding"), max(KS))
    return hits.join(v.select("kb_ordinal", "source_image_id"), "kb_ordinal").join(_first_lines(spark, d), "kb_ordinal", "left").withColumn("caption", F.coalesce("caption", F.lit("")))


def _fingerprinted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Vectors as images: sign bits are the fingerprint, one in forty ids share a digest; even labels are dataset A."""
    key = F.col("query_id").cast("string")
    rows = _vectors(spark, d).select(
        F.col("query_id").alias("ordinal"), key.alias("image_id"), key.alias("relative_path"), F.lit("").alias("image_path"), hash_split(key).alias("split"), F.array().cast("array<string>").alias("captions"),
        F.lower(F.lpad(F.hex(_bits(F.col("embedding"))), 16, "0")).alias("dhash64"), F.sha2((F.col("query_id") % 40).cast("string"), 256).alias("sha256"), F.col("source_image_id").alias("label"),
    )
    return rows.where("label % 2 = 0"), rows.where("label % 2 = 1")


def _near(spark: SparkSession, d: str, sources: int = 1) -> DataFrame:
    """Near pairs of query and source, which is the vector, or as many vectors with one remainder as leave `sources` of them."""
    a, kb = _fingerprinted(spark, d)
    source = F.col("ordinal") if sources == 1 else F.col("ordinal") % sources
    captions = kb.select(source.alias("source_image_id"), F.col("dhash64").alias("source_image_dhash64"), F.col("ordinal").alias("kb_ordinal"))
    return near_pairs(query_table(a).withColumn("query_id", F.col("query_id").cast("long")), captions, NEAR)


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    """Hits whose sources are the vectors themselves, with the label beside."""
    v = _vectors(spark, d)
    first = _documents(spark, d).select(F.col("ordinal").alias("kb_ordinal"), F.get("captions", F.lit(0)).alias("c"))
    captions = v.join(first, "kb_ordinal", "left").select(
        "kb_ordinal", F.col("kb_ordinal").alias("source_image_id"), F.col("kb_ordinal").cast("string").alias("source_relative_path"), F.lit("").alias("source_image_dhash64"), F.lit("").alias("source_image_sha256"), F.lit(0).alias("caption_index"),
        F.coalesce("c", F.lit("")).alias("caption"), caption_id(F.col("kb_ordinal").cast("string"), F.lit(0)).alias("caption_id"), F.col("source_image_id").alias("label"),
    )
    hits = exact_topk(v.select("query_id", "embedding"), v.select("kb_ordinal", "embedding"), max(KS))
    return hits_with_flags(hits, captions, _near(spark, d))


def q_exact_topk(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return exact_topk(v.select("query_id", "embedding"), v.select("kb_ordinal", "embedding"), 10).select("query_id", F.col("rank").cast("long").alias("rank"), "kb_ordinal", F.round("similarity", 6).alias("similarity"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names} | {"k": F.col("k").cast("long")})


def q_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.similarity_summary(_hits(spark, d), KS), "mean_similarity", "top1_mean", "top1_p05", "top1_p95")


def q_unique_source(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.unique_source_ratio(_hits(spark, d), KS), "unique_source_ratio")


def q_caption_distance(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    hits = exact_topk(v.select("query_id", "embedding"), v.select("kb_ordinal", "embedding"), max(KS))
    # documents without a vector are never hit, so no tokens are made of them
    captions = v.select("kb_ordinal").distinct().join(_first_lines(spark, d), "kb_ordinal", "left")
    return _rounded(metrics.caption_distance(hits, captions, KS), "mean_caption_distance")


def q_flagged(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.flagged_queries(_flagged(spark, d), KS))


def q_hits_flags(spark: SparkSession, d: str) -> DataFrame:
    return _flagged(spark, d).select("query_id", F.col("rank").cast("long").alias("rank"), "kb_ordinal", "caption", "flagged_near_duplicate_pair", F.coalesce("near_duplicate_hamming", F.lit(-1)).cast("long").alias("hamming"))


def q_results(spark: SparkSession, d: str) -> DataFrame:
    queries = query_table(_fingerprinted(spark, d)[0]).withColumn("query_id", F.col("query_id").cast("long"))
    rows = materialize(queries, _flagged(spark, d), _near(spark, d))
    return rows.select("query_id", "split", F.col("has_any_flagged_kb_near_duplicate").alias("has_near"), F.col("flagged_kb_near_duplicate_count").cast("long").alias("near"), F.array_join(F.transform("retrieved", lambda h: h["caption_id"]), ",").alias("captions"))


def q_contamination(spark: SparkSession, d: str) -> DataFrame:
    own = _documents(spark, d).select(F.col("ordinal").alias("query_id"), F.col("captions").alias("reference_captions"))
    return _rounded(metrics.contaminated_queries(_hits(spark, d), own, KS))


def q_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.sensitivity(_flagged(spark, d).drop("source_image_id").withColumnRenamed("label", "source_image_id"), _vectors(spark, d), _near(spark, d), KS), "mean_similarity", "unique_source_ratio")


def q_near_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.near_pair_counts(_near(spark, d))


def q_near_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, 100).select("query_id", "split", "source_image_id", F.col("hamming").cast("long").alias("hamming"))


def q_band_join(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d).withColumn("f", _bits(F.col("embedding")))
    a, b = v.select(F.col("query_id").alias("a_id"), F.col("f").alias("ha")), v.select(F.col("query_id").alias("b_id"), F.col("f").alias("hb"))
    return leakage.hamming_join(a, b, 12).select("a_id", "b_id", F.col("hamming").cast("long").alias("hamming"))


def q_hash_split(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", unit_interval(key, 42).alias("share"), hash_split(key).alias("split"))


def q_split_counts(spark: SparkSession, d: str) -> DataFrame:
    return integrity.split_counts(_documents(spark, d))


def q_smoke_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.smoke_sample(_documents(spark, d), 25).select("image_id", "stable_rank")


def q_stratified(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    return docs.where(F.col("image_id").isin(sampling.stratified_ids(docs, 24, key="image_id"))).select("image_id", "split")


def q_hard(spark: SparkSession, d: str) -> DataFrame:
    return leakage.hard_matches(*_sides(spark, d)).select("image_id", "split", "sha256", F.array_join("kb_image_ids", ",").alias("kb_image_ids"))


def q_duplicate_files(spark: SparkSession, d: str) -> DataFrame:
    return integrity.duplicate_files(_documents(spark, d)).select("sha256", F.array_join("image_ids", ",").alias("image_ids"))


def q_duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return integrity.duplicate_ids(spark.read.parquet(f"{d}/conversations.parquet"), "conv_id")


def _overlap(spark: SparkSession, d: str, normalized: bool) -> DataFrame:
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("ordinal"), F.col("item_id").cast("string").alias("image_id"), F.split("text", "\n").alias("captions"))
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("ordinal"), F.col("doc_id").cast("string").alias("image_id"), F.split("text", "\n").alias("captions"))
    return leakage.caption_overlap(items, docs, normalized).withColumns({c: F.array_join(c, ",") for c in ("image_ids", "kb_image_ids")})


def q_exact_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _overlap(spark, d, False)


def q_normalized_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _overlap(spark, d, True)


def q_soft(spark: SparkSession, d: str) -> DataFrame:
    return leakage.soft_matches(*_fingerprinted(spark, d), NEAR).withColumn("hamming", F.col("hamming").cast("long"))


def q_captions(spark: SparkSession, d: str) -> DataFrame:
    return caption_table(_documents(spark, d)).select("kb_ordinal", "caption_id", F.col("caption_index").cast("long").alias("caption_index"), "source_image_id", F.md5("caption").alias("caption_md5"))


def _checked(spark: SparkSession, d: str) -> DataFrame:
    labels = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("ordinal"), "quality")
    rows = _documents(spark, d).join(labels, "ordinal", "left")
    ok = F.coalesce(F.col("quality") == 1, F.lit(False))
    return rows.withColumn("ok", ok).withColumn("error", F.when(ok, "").when(F.col("quality") == 0, "undecodable").otherwise("file_missing"))


def q_integrity(spark: SparkSession, d: str) -> DataFrame:
    return integrity.summary(_checked(spark, d)).withColumn("mean_words", F.round("mean_words", 6))


def q_validation(spark: SparkSession, d: str) -> DataFrame:
    """Rules broken where sources above ten have lost their digest and unlabelled rows their captions."""
    late = F.regexp_extract("source", r"(\d+)", 1).cast("int") > 10
    rows = _checked(spark, d).withColumn("sha256", F.when(late, "").otherwise(F.col("sha256"))).withColumn("captions", F.when(F.col("error") == "file_missing", None).otherwise(F.col("captions")))
    return problems(rows.drop("dhash64")).groupBy("problem").agg(F.count("*").alias("n"), F.count_distinct("image_id").alias("images"))


def q_normalize(spark: SparkSession, d: str) -> DataFrame:
    norm = normalize_caption(F.col("text"))
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", norm.alias("normalized"), F.size(token_set(norm)).cast("long").alias("tokens"))


def q_paths(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", basename(F.col("url")).alias("base"), stem(F.col("url")).alias("stem"), caption_id(F.col("url"), (F.col("page_id") % 200).cast("int")).alias("caption_id"))


def q_ann_recall(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    centre, placed = ann.build(v.select("kb_ordinal", "embedding"))
    exact = exact_topk(v.select("query_id", "embedding"), v.select("kb_ordinal", "embedding"), max(KS))
    return metrics.ann_recall(exact, ann.search(centre, placed, v.select("query_id", "embedding"), max(KS)), KS)


def q_recall_of_half(spark: SparkSession, d: str) -> DataFrame:
    """Recall metrics of a search that sees vectors with even labels alone, against the search over all."""
    v = _vectors(spark, d)
    exact = exact_topk(v.select("query_id", "embedding"), v.select("kb_ordinal", "embedding"), max(KS))
    half = exact_topk(v.select("query_id", "embedding"), v.where("source_image_id % 2 = 0").select("kb_ordinal", "embedding"), max(KS))
    return _rounded(metrics.ann_recall(exact, half, KS), "recall", "tie_aware_recall", "full_agreement")


def q_hex_hamming(spark: SparkSession, d: str) -> DataFrame:
    h = F.sha2("text", 256)
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", hamming_hex64(F.substring(h, 1, 16), F.substring(h, 17, 16)).cast("long").alias("hamming"))


def q_classes(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", class_of(url, ("https:", "http:", "")).alias("class_name"), normalize_id(F.concat(F.lit("  "), url)).alias("record_id"))


def q_ordinal(spark: SparkSession, d: str) -> DataFrame:
    return with_ordinal(spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url").dropDuplicates(["url"]), "url").select("url", "ordinal")


def q_normalize_nfkc(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", normalize_caption(F.col("text"), compose=True).alias("normalized"))


def q_l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    unit = l2_normalize(F.col("embedding"))
    total = lambda f: F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + f(x)), 6)
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", total(F.abs).alias("absolute"), total(lambda x: x * x).alias("squares"))


def q_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Manifest rows, written as JSON lines and read back by the manifest's schema."""
    path = scratch_folder(spark, "manifest")
    sinks.write_jsonl(to_manifest(_checked(spark, d)), path)
    rows = sinks.read_manifest(spark, path)
    return rows.select("image_id", "source", "split", "sha256", F.col("num_captions").cast("long").alias("num_captions"), "ok", "error", F.md5(F.array_join("captions", "\n")).alias("captions_md5"))


def q_manifest_csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_folder(spark, "manifest")
    sinks.write_csv(to_manifest(_checked(spark, d)), path)
    rows = sinks.read_csv(spark, path)
    return rows.select("image_id", "split", F.md5(F.coalesce("captions", F.lit(""))).alias("captions_md5"))


def q_validation_counts(spark: SparkSession, d: str) -> DataFrame:
    found = validation(to_manifest(_checked(spark, d)))
    return spark.createDataFrame([(k, int(found[k])) for k in ("n_records", "n_ok", "n_problems")], "name string, n long")


def q_audit_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counters of the whole leakage audit, whether the gate asks them to be zero, and fails."""
    counts = leakage.audit(*_sides(spark, d))["counts"]
    verdict, failed = leakage.gate(counts, dict.fromkeys(("hard_image_matches", "hard_image_matches_test", "exact_caption_overlaps"), True))
    return spark.createDataFrame([(k, int(n), k in failed, verdict) for k, n in counts.items()], "name string, n long, failed boolean, gate string")


def q_official_splits(spark: SparkSession, d: str) -> DataFrame:
    """Splits of benchmark items by a splits.json of two thirds of them, the others by hash."""
    items = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id")
    folder = scratch_folder(spark, "splits")
    ids = [r["item_id"] for r in items.orderBy("item_id").collect()]
    write_file(spark, f"{folder}/splits.json", json.dumps({s: [f"d/{i}.jpg" for i in ids if i % 6 == k] for k, s in enumerate(("train", "val", "test", "other")) if k < 3} | {"train": [f"d\\{i}.jpg" for i in ids if i % 6 in (0, 3)]}))
    rows = items.select("item_id", F.format_string("a::%d.jpg", "item_id").alias("image_id"), F.format_string("d/%d.jpg", "item_id").alias("relative_path"))
    return apply_splits(rows, official_splits(spark, folder)).select("item_id", "split", "split_is_official")


def q_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Captions that annotations give to images: the lines of benchmark items, some of them under a shared name."""
    items = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text")
    data = {"images": [{"filename": f"d/{r['item_id'] // 2}.png", "sentences": [{"raw": x} for x in r["text"].split(". ")]} for r in items.orderBy("item_id").collect()]}
    images = items.select("item_id", F.format_string("e/%d.png", "item_id").alias("relative_path"))
    rows = with_captions(images, alias_table(spark, parse_annotations(data)))
    return rows.select("item_id", F.size("captions").cast("long").alias("captions"), F.md5(F.array_join("captions", "|")).alias("captions_md5"))


QUERIES = {
    "hamming_hex": q_hex_hamming, "path_classes": q_classes, "file_order": q_ordinal, "normalize_captions_nfkc": q_normalize_nfkc, "l2_normalize": q_l2_normalize, "manifest_jsonl": q_manifest, "manifest_csv": q_manifest_csv,
    "validation_counts": q_validation_counts, "audit_counts": q_audit_counts, "official_splits": q_official_splits, "annotation_join": q_annotations, "near_pairs": q_near_pairs, "retrieval_results": q_results,
    "exact_topk": q_exact_topk, "similarity_summary": q_similarity, "unique_source_ratio": q_unique_source, "caption_distance": q_caption_distance, "flagged_queries": q_flagged, "hits_with_flags": q_hits_flags,
    "contamination": q_contamination, "sensitivity": q_sensitivity, "near_pair_counts": q_near_pair_counts, "hamming_band_join": q_band_join, "soft_leakage": q_soft, "hard_leakage": q_hard,
    "hash_split": q_hash_split, "split_counts": q_split_counts, "smoke_sample": q_smoke_sample, "stratified_sample": q_stratified, "duplicate_files": q_duplicate_files, "duplicate_ids": q_duplicate_ids,
    "exact_caption_overlap": q_exact_overlap, "normalized_caption_overlap": q_normalized_overlap, "unnest_captions": q_captions, "integrity_summary": q_integrity, "schema_validation": q_validation,
    "normalize_captions": q_normalize, "path_parts": q_paths, "ann_recall": q_ann_recall, "recall_metrics": q_recall_of_half,
}

_V = """v AS MATERIALIZED (SELECT vec_id, CAST(label AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS MATERIALIZED (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v)"""
_ALL = f"""{_V},
s AS (SELECT q.vec_id AS query_id, k.vec_id AS kb_ordinal, k.label AS source_image_id, list_inner_product(q.e, k.e) / (q.n * k.n) AS similarity FROM u q, u k),
h AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, kb_ordinal) AS rank FROM s) WHERE rank <= 10)"""
_DOCS = """d AS MATERIALIZED (SELECT doc_id AS ordinal, CAST(doc_id AS VARCHAR) AS image_id, sha256(text) AS sha256, source, CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) AS number,
  list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS captions, CAST('0x' || substr(sha256('42::' || doc_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS share FROM documents),
dd AS MATERIALIZED (SELECT *, CASE WHEN share < 0.7::DOUBLE THEN 'train' WHEN share < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS split FROM d)"""
_CAPTIONED = "c AS MATERIALIZED (SELECT h.*, coalesce(dd.captions[1], '') AS caption FROM h LEFT JOIN dd ON h.kb_ordinal = dd.ordinal)"
_KS = "ks AS (SELECT CAST(unnest([1, 3, 5, 10]) AS BIGINT) AS k)"
_PAIRS = f"""p AS MATERIALIZED (SELECT a.vec_id AS query_id, b.vec_id AS kb_ordinal, CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda z: CAST((z[1] > 0) <> (z[2] > 0) AS INT))) AS BIGINT) AS hamming
  FROM v a, v b WHERE a.label % 2 = 0 AND b.label % 2 = 1),
near AS MATERIALIZED (SELECT p.*, CASE WHEN x < 0.7::DOUBLE THEN 'train' WHEN x < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, CAST('0x' || substr(sha256('42::' || query_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS x FROM p WHERE hamming <= {NEAR}) p)"""
_NORM = "trim(regexp_replace(regexp_replace(lower(trim({0})), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_RATIO = "(SELECT query_id, k, count(DISTINCT source_image_id) / CAST(k AS DOUBLE) AS r FROM {0}, ks WHERE rank <= k GROUP BY 1, 2)"


def _overlap_sql(name: str, text: str, kept: str) -> str:
    def side(key: str, table: str) -> str:
        lines = f"SELECT {key} AS o, unnest(string_split(text, chr(10))) AS raw FROM {table}"
        return f"SELECT t, array_to_string(list_slice(list(CAST(o AS VARCHAR) ORDER BY o, CAST(o AS VARCHAR)), 1, 20), ',') AS ids FROM (SELECT o, {text} AS t FROM ({lines})) WHERE {kept} GROUP BY t"

    return f"SELECT a.t AS {name}, a.ids AS image_ids, b.ids AS kb_image_ids FROM ({side('item_id', 'benchmark')}) a JOIN ({side('doc_id', 'documents')}) b ON a.t = b.t"


_CHECKED = f"""{_DOCS}, x AS (SELECT dd.*, coalesce(quality = 1, false) AS ok, CASE WHEN quality = 1 THEN '' WHEN quality = 0 THEN 'undecodable' ELSE 'file_missing' END AS error FROM dd LEFT JOIN labels ON dd.ordinal = labels.doc_id)"""
# Manifest fields that the validated rows don't have.
_MISSING = ["schema_version", "role", "image_path", "num_captions", "class_name", "width", "height", "file_size_bytes", "dhash64"]

ORACLE_SQL: dict[str, str] = {
    "exact_topk": f"WITH {_ALL} SELECT query_id, rank, kb_ordinal, round(similarity, 6) AS similarity FROM h",
    "similarity_summary": f"WITH {_ALL}, {_KS} SELECT k, round(avg(similarity), 6) AS mean_similarity, round(avg(similarity) FILTER (rank = 1), 6) AS top1_mean, round(quantile_cont(similarity, 0.05) FILTER (rank = 1), 6) AS top1_p05, round(quantile_cont(similarity, 0.95) FILTER (rank = 1), 6) AS top1_p95 FROM h, ks WHERE rank <= k GROUP BY k",
    "unique_source_ratio": f"WITH {_ALL}, {_KS} SELECT k, round(avg(r), 6) AS unique_source_ratio FROM {_RATIO.format('h')} GROUP BY k",
    "caption_distance": f"""WITH {_ALL}, {_DOCS}, {_CAPTIONED}, {_KS},
      t AS MATERIALIZED (SELECT query_id, rank, list_distinct(list_filter(string_split({_NORM.format('caption')}, ' '), lambda w: w <> '')) AS t FROM c),
      j AS MATERIALIZED (SELECT a.query_id, b.rank, CASE WHEN len(list_distinct(list_concat(a.t, b.t))) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(list_concat(a.t, b.t))) AS DOUBLE) END AS x FROM t a JOIN t b ON a.query_id = b.query_id AND a.rank < b.rank),
      m AS (SELECT k, avg(x) AS x FROM (SELECT query_id, k, avg(x) AS x FROM j, ks WHERE rank <= k GROUP BY 1, 2) GROUP BY k)
      SELECT ks.k, round(m.x, 6) AS mean_caption_distance FROM ks LEFT JOIN m ON ks.k = m.k""",
    "flagged_queries": f"WITH {_ALL}, {_PAIRS}, {_KS} SELECT k, count(*) FILTER (f) AS queries_with_flagged_hit FROM (SELECT h.query_id, k, bool_or(near.hamming IS NOT NULL) AS f FROM h CROSS JOIN ks LEFT JOIN near ON h.query_id = near.query_id AND h.kb_ordinal = near.kb_ordinal WHERE rank <= k GROUP BY 1, 2) GROUP BY k",
    "hits_with_flags": f"WITH {_ALL}, {_DOCS}, {_CAPTIONED}, {_PAIRS} SELECT c.query_id, c.rank, c.kb_ordinal, c.caption, near.hamming IS NOT NULL AS flagged_near_duplicate_pair, coalesce(near.hamming, -1) AS hamming FROM c LEFT JOIN near ON c.query_id = near.query_id AND c.kb_ordinal = near.kb_ordinal",
    "contamination": f"WITH {_ALL}, {_DOCS}, {_CAPTIONED}, {_KS} SELECT k, count(*) FILTER (f) AS queries_with_reference_string FROM (SELECT c.query_id, k, bool_or(list_contains(dd.captions, c.caption)) AS f FROM c CROSS JOIN ks JOIN dd ON c.query_id = dd.ordinal WHERE rank <= k GROUP BY 1, 2) GROUP BY k",
    "sensitivity": f"""WITH {_ALL}, {_PAIRS}, {_KS}, r AS MATERIALIZED (SELECT * FROM h WHERE query_id NOT IN (SELECT query_id FROM near)),
      n AS (SELECT count(*) FILTER (vec_id IN (SELECT query_id FROM near)) AS excluded, count(*) FILTER (vec_id NOT IN (SELECT query_id FROM near)) AS remaining FROM v),
      m AS (SELECT k, avg(similarity) AS s FROM r, ks WHERE rank <= k GROUP BY k), q AS (SELECT k, avg(r) AS r FROM {_RATIO.format('r')} GROUP BY k)
      SELECT ks.k, n.excluded, n.remaining, round(m.s, 6) AS mean_similarity, round(q.r, 6) AS unique_source_ratio FROM ks CROSS JOIN n LEFT JOIN m ON ks.k = m.k LEFT JOIN q ON ks.k = q.k""",
    "near_pair_counts": f"WITH {_V}, {_PAIRS} SELECT split, count(*) AS pairs, count(DISTINCT query_id) AS queries FROM near GROUP BY split",
    "hamming_band_join": f"WITH {_V}, x AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda z: CAST((z[1] > 0) <> (z[2] > 0) AS INT))) AS BIGINT) AS hamming FROM v a, v b) SELECT * FROM x WHERE hamming <= 12",
    "soft_leakage": f"WITH {_V}, {_PAIRS} SELECT CAST(query_id AS VARCHAR) AS image_id, split, CAST(kb_ordinal AS VARCHAR) AS kb_image_id, hamming, query_id % 40 IN (SELECT vec_id % 40 FROM v WHERE label % 2 = 1) AS already_hard_match FROM near",
    "near_pairs": f"WITH {_V}, {_PAIRS} SELECT query_id, split, f.s AS source_image_id, hamming FROM near JOIN (SELECT vec_id % 100 AS s, min(vec_id) AS kb_ordinal FROM v WHERE label % 2 = 1 GROUP BY 1) f USING (kb_ordinal)",
    "retrieval_results": f"""WITH {_ALL}, {_PAIRS}, q AS (SELECT vec_id, CAST('0x' || substr(sha256('42::' || vec_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS x FROM v WHERE label % 2 = 0)
      SELECT vec_id AS query_id, CASE WHEN x < 0.7::DOUBLE THEN 'train' WHEN x < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS split, n.n IS NOT NULL AS has_near, coalesce(n.n, 0) AS near,
      r.c AS captions FROM q LEFT JOIN (SELECT query_id, count(*) AS n FROM near GROUP BY 1) n ON vec_id = n.query_id
      JOIN (SELECT query_id, string_agg(kb_ordinal || '::caption::00', ',' ORDER BY rank) AS c FROM h GROUP BY 1) r ON vec_id = r.query_id""",
    "hamming_hex": "SELECT doc_id, CAST(list_sum(list_transform(range(1, 17), lambda i: bit_count(xor(CAST('0x' || substr(h, i, 1) AS BIGINT), CAST('0x' || substr(h, i + 16, 1) AS BIGINT))))) AS BIGINT) AS hamming FROM (SELECT doc_id, sha256(text) AS h FROM documents)",
    "path_classes": "SELECT page_id, coalesce(list_filter(p[1:len(p) - 1], lambda x: lower(x) NOT IN ('https:', 'http:', ''))[1], '') AS class_name, regexp_replace(p[-1], '^(.+)\\.[^.]+$', '\\1') AS record_id FROM (SELECT page_id, string_split(url, '/') AS p FROM pages)",
    "file_order": "SELECT url, row_number() OVER (ORDER BY lower(url), url) - 1 AS ordinal FROM (SELECT DISTINCT url FROM pages)",
    "normalize_captions_nfkc": f"SELECT item_id, {_NORM.format('text')} AS normalized FROM benchmark",
    "l2_normalize": f"WITH {_V} SELECT vec_id, round(list_sum(list_transform(e, lambda x: abs(x / n))), 6) AS absolute, round(list_sum(list_transform(e, lambda x: (x / n) * (x / n))), 6) AS squares FROM u",
    "manifest_jsonl": f"WITH {_CHECKED} SELECT image_id, source, split, sha256, CAST(len(captions) AS BIGINT) AS num_captions, ok, error, md5(array_to_string(captions, chr(10))) AS captions_md5 FROM x",
    "manifest_csv": f"WITH {_CHECKED} SELECT image_id, split, md5(array_to_string(captions, ' || ')) AS captions_md5 FROM x",
    "validation_counts": f"WITH {_CHECKED} SELECT 'n_records' AS name, count(*) AS n FROM x UNION ALL SELECT 'n_ok', count(*) FILTER (ok) FROM x UNION ALL SELECT 'n_problems', count(*) FILTER (ok AND len(captions) < 1) FROM x",
    "audit_counts": f"""WITH {_DOCS}, a AS (SELECT * FROM dd WHERE number % 2 = 0), b AS (SELECT * FROM dd WHERE number % 2 = 1),
      ca AS (SELECT DISTINCT unnest(captions) AS c FROM a), cb AS (SELECT DISTINCT unnest(captions) AS c FROM b),
      na AS (SELECT DISTINCT {_NORM.format('c')} AS c FROM ca), nb AS (SELECT DISTINCT {_NORM.format('c')} AS c FROM cb),
      n AS (SELECT 'hard_image_matches' AS name, count(*) AS n FROM a WHERE sha256 IN (SELECT sha256 FROM b) UNION ALL SELECT 'hard_image_matches_test', count(*) FROM a WHERE split = 'test' AND sha256 IN (SELECT sha256 FROM b)
        UNION ALL SELECT unnest(['soft_image_matches', 'soft_image_matches_test', 'soft_image_matches_new']), 0
        UNION ALL SELECT 'exact_caption_overlaps', count(*) FROM ca WHERE c IN (SELECT c FROM cb) UNION ALL SELECT 'normalized_caption_overlaps', count(*) FROM na WHERE c <> '' AND c IN (SELECT c FROM nb)
        UNION ALL SELECT 'a_images', count(*) FROM a UNION ALL SELECT 'kb_images', count(*) FROM b),
      g AS (SELECT name, n, n > 0 AND name IN ('hard_image_matches', 'hard_image_matches_test', 'exact_caption_overlaps') AS failed FROM n)
      SELECT *, CASE WHEN bool_or(failed) OVER () THEN 'FAIL' ELSE 'PASS' END AS gate FROM g""",
    "official_splits": """SELECT item_id, CASE WHEN item_id % 6 IN (0, 3) THEN 'train' WHEN item_id % 6 = 1 THEN 'val' WHEN item_id % 6 = 2 THEN 'test' WHEN x < 0.7::DOUBLE THEN 'train' WHEN x < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS split, item_id % 6 < 4 AS split_is_official
      FROM (SELECT item_id, CAST('0x' || substr(sha256('42::a::' || item_id || '.jpg'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS x FROM benchmark)""",
    "annotation_join": """WITH l AS (SELECT item_id // 2 AS k, item_id, unnest(string_split(text, '. ')) AS c, generate_subscripts(string_split(text, '. '), 1) AS i FROM benchmark),
      g AS (SELECT k, count(*) AS n, string_agg(trim(c), '|' ORDER BY item_id, i) AS c FROM l WHERE trim(c) <> '' GROUP BY k)
      SELECT item_id, coalesce(g.n, 0) AS captions, md5(coalesce(g.c, '')) AS captions_md5 FROM benchmark LEFT JOIN g ON item_id = g.k""",
    "hard_leakage": f"WITH {_DOCS} SELECT a.image_id, a.split, a.sha256, b.ids AS kb_image_ids FROM dd a JOIN (SELECT sha256, array_to_string(list(image_id ORDER BY ordinal), ',') AS ids FROM dd WHERE number % 2 = 1 GROUP BY 1) b ON a.sha256 = b.sha256 WHERE a.number % 2 = 0",
    "hash_split": f"WITH {_DOCS} SELECT ordinal AS doc_id, share, split FROM dd",
    "split_counts": f"WITH {_DOCS} SELECT split, count(*) AS n FROM dd GROUP BY split",
    "smoke_sample": f"SELECT CAST(doc_id AS VARCHAR) AS image_id, sha256('42::' || doc_id) AS stable_rank FROM documents ORDER BY 2, 1 LIMIT 25",
    "duplicate_files": f"WITH {_DOCS} SELECT sha256, array_to_string(list(image_id ORDER BY image_id), ',') AS image_ids FROM dd GROUP BY sha256 HAVING count(*) > 1",
    "duplicate_ids": "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1",
    "exact_caption_overlap": _overlap_sql("caption", "raw", "true"),
    "normalized_caption_overlap": _overlap_sql("normalized_caption", _NORM.format("raw"), "t <> ''"),
    "unnest_captions": f"""WITH {_DOCS}, c AS (SELECT ordinal, image_id, unnest(captions) AS caption, generate_subscripts(captions, 1) - 1 AS i FROM dd)
      SELECT row_number() OVER (ORDER BY ordinal, i) - 1 AS kb_ordinal, image_id || '::caption::' || CASE WHEN i < 10 THEN '0' ELSE '' END || i AS caption_id, CAST(i AS BIGINT) AS caption_index, image_id AS source_image_id, md5(caption) AS caption_md5 FROM c""",
    "integrity_summary": f"""WITH {_CHECKED}, w AS (SELECT *, len(captions) AS n, coalesce(list_sum(list_transform(captions, lambda c: len(list_filter(regexp_split_to_array(c, '\\s+'), lambda t: t <> '')))), 0) AS w FROM x)
      SELECT count(*) AS n_records, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_bad, count(*) FILTER (error = 'file_missing') AS n_missing_files, count(*) FILTER (NOT ok AND error NOT IN ('', 'file_missing')) AS n_unreadable,
      count(*) FILTER (n = 0) AS n_without_captions, CAST(sum(n) AS BIGINT) AS n_captions, round(CAST(sum(w) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) AS mean_words FROM w""",
    "schema_validation": f"""WITH {_CHECKED}, y AS (SELECT image_id, ok, CASE WHEN number > 10 THEN '' ELSE sha256 END AS sha, CASE WHEN error = 'file_missing' THEN NULL ELSE captions END AS caps FROM x),
      z AS (SELECT image_id, unnest({[f'missing:{m}' for m in _MISSING]}) AS problem FROM y UNION ALL SELECT image_id, 'captions_not_list' FROM y WHERE caps IS NULL UNION ALL SELECT image_id, 'ok_without_sha256' FROM y WHERE ok AND sha = '' UNION ALL SELECT image_id, 'ok_without_captions' FROM y WHERE ok AND coalesce(len(caps), 0) < 1)
      SELECT problem, count(*) AS n, count(DISTINCT image_id) AS images FROM z GROUP BY problem""",
    "normalize_captions": f"SELECT item_id, {_NORM.format('text')} AS normalized, CAST(len(list_distinct(list_filter(string_split({_NORM.format('text')}, ' '), lambda w: w <> ''))) AS BIGINT) AS tokens FROM benchmark",
    "path_parts": "SELECT page_id, b AS base, regexp_replace(b, '^(.+)\\.[^.]+$', '\\1') AS stem, url || '::caption::' || CASE WHEN page_id % 200 < 10 THEN '0' ELSE '' END || page_id % 200 AS caption_id FROM (SELECT page_id, url, string_split(replace(url, '\\', '/'), '/')[-1] AS b FROM pages)",
    "recall_metrics": f"""WITH {_ALL}, {_KS}, g AS MATERIALIZED (SELECT * FROM (SELECT query_id, kb_ordinal, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, kb_ordinal) AS rank FROM s WHERE source_image_id % 2 = 0) WHERE rank <= 10),
      e AS (SELECT query_id, k, min(similarity) AS edge, list(kb_ordinal) AS ids FROM h, ks WHERE rank <= k GROUP BY 1, 2),
      r AS (SELECT e.query_id, e.k, count(*) FILTER (list_contains(e.ids, g.kb_ordinal)) / CAST(e.k AS DOUBLE) AS r, count(*) FILTER (g.similarity >= e.edge - 1e-6) / CAST(e.k AS DOUBLE) AS t FROM e JOIN g ON e.query_id = g.query_id AND g.rank <= e.k GROUP BY e.query_id, e.k)
      SELECT k, round(avg(r), 6) AS recall, round(avg(t), 6) AS tie_aware_recall, round(avg(CAST(r = 1 AS DOUBLE)), 6) AS full_agreement FROM r GROUP BY k""",
}
