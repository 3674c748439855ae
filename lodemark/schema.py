"""The manifest: one row per image, and its validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "1.0.0"
# Field names and types of the manifest, in their order.
_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "array": T.ArrayType(T.StringType())}
MANIFEST = T.StructType(
    [
        T.StructField(name, _KINDS[kind])
        for name, kind in (
            *((n, "string") for n in ("schema_version", "source", "role", "image_id", "image_path", "relative_path", "split")),
            ("captions", "array"), ("num_captions", "int"), ("class_name", "string"), ("width", "int"), ("height", "int"), ("file_size_bytes", "long"),
            ("sha256", "string"), ("dhash64", "string"), ("ok", "boolean"), ("error", "string"),
        )
    ]
)


def to_manifest(rows: DataFrame) -> DataFrame:
    """rows with every manifest field, in order: what is missing or null is '', 0, false or no caption; captions are counted."""
    empty = {"string": F.lit(""), "integer": F.lit(0), "long": F.lit(0), "boolean": F.lit(False), "array": F.array().cast("array<string>")}
    filled = [F.coalesce(F.col(f.name).cast(f.dataType), empty[f.dataType.typeName()]).alias(f.name) if f.name in rows.columns else empty[f.dataType.typeName()].cast(f.dataType).alias(f.name) for f in MANIFEST]
    return rows.select(filled).withColumn("num_captions", F.size("captions")).select([f.name for f in MANIFEST])


def problems(rows: DataFrame) -> DataFrame:
    """One row per broken rule: image_id, problem_index, problem. A field that isn't a column counts as missing on every row.

    Columns missing; captions null; ok without sha256; ok without a caption.
    """
    has = set(rows.columns)
    rules = [F.lit(f"missing:{f.name}") for f in MANIFEST if f.name not in has]
    captions = F.col("captions") if "captions" in has else F.lit(None).cast("array<string>")
    rules.append(F.when(captions.isNull(), "captions_not_list"))
    if "ok" in has:
        sha = F.col("sha256") if "sha256" in has else F.lit("")
        rules += [F.when(F.col("ok") & (F.coalesce(sha, F.lit("")) == ""), "ok_without_sha256"), F.when(F.col("ok") & (F.coalesce(F.size(captions), F.lit(0)) < 1), "ok_without_captions")]
    key = F.col("image_id") if "image_id" in has else F.lit("").alias("image_id")
    return rows.select(key, F.posexplode(F.array_compact(F.array(*rules))).alias("problem_index", "problem"))


def validation(rows: DataFrame, preview: int = 50) -> dict:
    """Counts of rows, sound rows and problems, and the first problems by image id."""
    found = problems(rows)
    n = rows.agg(F.count("*").alias("n"), F.count_if(F.col("ok")).alias("ok")).first()
    head = found.orderBy("image_id", "problem_index").limit(preview).collect()
    return {"n_records": n["n"], "n_ok": n["ok"], "n_problems": found.count(), "problems_preview": [f"{r['image_id']}: {r['problem']}" for r in head]}
