"""Checks of one manifest by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemark.functions.text import words


def summary(rows: DataFrame) -> DataFrame:
    """One row: n_records, n_ok, n_bad, n_missing_files, n_unreadable, n_without_captions, n_captions, mean_words."""
    per = rows.select("ok", "error", F.size("captions").alias("n"), F.aggregate("captions", F.lit(0), lambda s, c: s + F.size(words(c))).alias("w"))
    bad = ~F.col("ok") & ~F.col("error").isin("", "file_missing")
    return per.agg(
        F.count("*").alias("n_records"),
        F.count_if("ok").alias("n_ok"),
        F.count_if(~F.col("ok")).alias("n_bad"),
        F.count_if(F.col("error") == "file_missing").alias("n_missing_files"),
        F.count_if(bad).alias("n_unreadable"),
        F.count_if(F.col("n") == 0).alias("n_without_captions"),
        F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0)).alias("n_captions"),
        F.when(F.sum("n") > 0, F.sum("w") / F.sum("n")).otherwise(F.lit(0.0)).alias("mean_words"),
    )


def split_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count("*").alias("n")).orderBy("split")


def duplicate_ids(rows: DataFrame, key: str = "image_id") -> DataFrame:
    """Ids that more than one row has, with how many."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_files(rows: DataFrame) -> DataFrame:
    """Digests that more than one row has, with their ids in order."""
    return rows.where(F.col("sha256") != "").groupBy("sha256").agg(F.array_sort(F.collect_list("image_id")).alias("image_ids")).where(F.size("image_ids") > 1)


def report(rows: DataFrame, preview: int = 50) -> dict:
    """The summary with previews; the mean is rounded here and nowhere else."""
    out = summary(rows).first().asDict()
    out["mean_words"] = round(out["mean_words"], 3)
    out["by_split"] = {r["split"]: r["n"] for r in split_counts(rows).collect()}
    ids = lambda df: [r["image_id"] for r in df.orderBy("image_id").select("image_id").limit(preview).collect()]
    out["missing_files"] = ids(rows.where(F.col("error") == "file_missing"))
    out["unreadable"] = ids(rows.where(~F.col("ok") & ~F.col("error").isin("", "file_missing")))
    out["without_captions"] = ids(rows.where(F.size("captions") == 0))
    out["duplicate_ids"] = ids(duplicate_ids(rows))
    out["duplicate_files"] = [r.asDict() for r in duplicate_files(rows).orderBy("sha256").limit(preview).collect()]
    return out
