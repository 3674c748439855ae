"""Captions from annotation files of several shapes, sidecar texts and split files.

The files are small beside the images; they are read on the driver and become tables keyed by alias.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemark.functions.text import basename, normalize_id, stem, strip
from lodemark.sources.files import exists, read_text

NAME_KEYS = ("filename", "filepath", "image", "file_name")
#: Names of a file where images and annotations are apart, and in split files.
FILE_KEYS = ("filename", "file_name", "filepath")
SPLITS = ("train", "val", "test")


def _first(item: dict, *keys: str):
    """The first value that isn't empty."""
    return next((item[k] for k in keys if item.get(k)), None)


def _texts(value, keys: tuple[str, ...]) -> list[str]:
    """Captions of a string, a list of strings or a list of objects (told by its first element)."""
    if not value:
        return []
    if isinstance(value, str):
        return [value]
    if isinstance(value[0], dict):
        return [str(_first(x, *keys) or "") for x in value]
    return [str(x) for x in value]


def parse_annotations(data, knowledge_base: bool = False) -> list[tuple[str, list[str], str]]:
    """(file key, captions, class) of each entry, in the file's order.

    Shapes: a list of objects; images with a separate list of annotations by image id; images (in a knowledge base also
    data) that hold their captions; for a dataset, last, a map of file to captions. A knowledge base reads classes too and
    yields nothing of an object without images; anything else is an error.
    """
    keys = ("raw", "caption", "sent") if knowledge_base else ("raw", "caption")
    kind = lambda x: str(_first(x, "class", "category") or "") if knowledge_base else ""
    entry = lambda x, *more: (str(_first(x, *NAME_KEYS) or ""), _texts(_first(x, "captions", "sentences", *more), keys), kind(x))
    if isinstance(data, list):
        return [entry(x, "raw") for x in data if isinstance(x, dict)]
    if not isinstance(data, dict):
        raise ValueError("annotations are neither a list nor an object")
    if "images" in data and "annotations" in data:
        files = {x["id"]: x for x in data["images"] if x.get("id") is not None and _first(x, *FILE_KEYS)}
        grouped: dict = {k: [] for k in files} if knowledge_base else {}
        for x in data["annotations"]:
            text = str(_first(x, "caption", "raw") or "")
            if x.get("image_id") in files and (text or knowledge_base):
                grouped.setdefault(x["image_id"], []).append(text)
        return [(str(_first(files[k], *FILE_KEYS)), texts, kind(files[k])) for k, texts in grouped.items()]
    images = data.get("images") or (data.get("data") if knowledge_base else None)
    if isinstance(images, list):
        return [entry(x, *(["raw"] if knowledge_base else [])) for x in images if isinstance(x, dict)]
    if knowledge_base:
        if images:
            raise ValueError("the images of a knowledge base's annotations are not a list")
        return []
    if "images" in data:
        return []
    return [(k, _texts(v, keys), "") for k, v in data.items()]


def alias_table(spark: SparkSession, entries: list[tuple[str, list[str], str]], keep_empty: bool = False) -> DataFrame:
    """alias, captions, class_name: each entry under its base name, stem and path, once each.

    Entries that share an alias have their captions joined in order, and the class of the last that has one. Captions are stripped and empty ones left out; an
    entry without captions is left out too, unless keep_empty.
    """
    rows = spark.createDataFrame([(i, k, c, n) for i, (k, c, n) in enumerate(entries)], "i long, k string, captions array<string>, class_name string")
    path = F.replace(strip(F.col("k")), F.lit("\\"), F.lit("/"))
    kept = F.filter(F.transform("captions", strip), lambda c: c != "")
    rows = rows.where("k <> ''").select("i", F.explode(F.array_distinct(F.array(basename(path), stem(path), path))).alias("alias"), kept.alias("captions"), "class_name")
    rows = rows if keep_empty else rows.where(F.size("captions") > 0)
    grouped = rows.groupBy("alias").agg(F.array_sort(F.collect_list(F.struct("i", "captions", "class_name"))).alias("e"))
    names = F.filter(F.transform("e", lambda x: x["class_name"]), lambda c: c != "")
    return grouped.select("alias", F.flatten(F.transform("e", lambda x: x["captions"])).alias("captions"), F.coalesce(F.get(names, F.size(names) - 1), F.lit("")).alias("class_name"))


def with_captions(images: DataFrame, aliases: DataFrame, knowledge_base: bool = False) -> DataFrame:
    """images with captions and annotated_class: of the base name, else the stem, else the path.

    A dataset's alias without captions was never a hit; a knowledge base's is one, so nothing further is looked up.
    """
    out = images
    for k, alias in enumerate((basename(F.col("relative_path")), stem(F.col("relative_path")), F.col("relative_path"))):
        found = aliases.select(F.col("alias").alias(f"_a{k}"), F.struct("captions", "class_name").alias(f"_e{k}"))
        out = out.withColumn("_k", alias).join(found, F.col("_k") == F.col(f"_a{k}"), "left").drop("_k", f"_a{k}")
    hit = F.coalesce("_e0", "_e1", "_e2")
    return out.withColumn("captions", F.coalesce(hit["captions"], F.array().cast("array<string>"))).withColumn("annotated_class", F.coalesce(hit["class_name"], F.lit(""))).drop("_e0", "_e1", "_e2")


def sidecar_captions(spark: SparkSession, root: str) -> DataFrame:
    """_base (path without suffix) and lines of every .txt under root: stripped, blank ones left out, the first of equals kept."""
    texts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.lower("path").endswith(".txt"))
    lines = F.split(F.col("content").cast("string"), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]")
    kept = F.array_distinct(F.filter(F.transform(lines, strip), lambda x: x != ""))
    return texts.select(F.regexp_replace(F.regexp_replace("path", r"^(\w+):/+", "$1:/"), r"\.[^./]+$", "").alias("_base"), kept.alias("lines"))


def with_sidecars(spark: SparkSession, images: DataFrame, root: str) -> DataFrame:
    """images without captions get those of <image>.txt, else of captions/<stem>.txt under root."""
    from lodemark.sources.files import _clean, qualified

    beside = sidecar_captions(spark, root)
    base = F.regexp_replace(F.regexp_replace("image_path", r"^(\w+):/+", "$1:/"), r"\.[^./]+$", "")
    folder = F.concat(F.lit(_clean(qualified(spark, root)).rstrip("/") + "/captions/"), stem(F.col("relative_path")))
    out = images.withColumn("_i", base).withColumn("_c", folder)
    out = out.join(beside.select(F.col("_base").alias("_i"), F.col("lines").alias("_li")), "_i", "left").join(beside.select(F.col("_base").alias("_c"), F.col("lines").alias("_lc")), "_c", "left")
    return out.withColumn("captions", F.when(F.size("captions") > 0, F.col("captions")).otherwise(F.coalesce("_li", "_lc", "captions"))).drop("_i", "_c", "_li", "_lc")


def official_splits(spark: SparkSession, root: str) -> list[tuple[str, str]] | None:
    """(record key, split) of splits.json, else dataset.json, else {train,val,test}.txt; None if none of them says.

    An empty splits.json ends the search. In dataset.json, which has to be an object with a list of images, splits count in
    any case and restval is val. Lines of a text file that begin with # are comments; an empty one is an answer: no key.
    """
    root = root.rstrip("/")
    if exists(spark, f"{root}/splits.json"):
        data = json.loads(read_text(spark, f"{root}/splits.json"))
        return [(str(k), s) for s in SPLITS for k in data.get(s, [])] or None
    if exists(spark, f"{root}/dataset.json"):
        data = json.loads(read_text(spark, f"{root}/dataset.json"))
        images = data.get("images") if isinstance(data, dict) else None
        named = [(_first(x, *FILE_KEYS), str(x.get("split") or "").lower()) for x in images if isinstance(x, dict)] if isinstance(images, list) else []
        if found := [(str(k), "val" if s == "restval" else s) for k, s in named if k and s in (*SPLITS, "restval")]:
            return found
    texts = [(s, f"{root}/{s}.txt") for s in SPLITS if exists(spark, f"{root}/{s}.txt")]
    return [(key, s) for s, path in texts for line in read_text(spark, path).splitlines() if (key := line.strip()) and not key.startswith("#")] if texts else None


def apply_splits(rows: DataFrame, official: list[tuple[str, str]] | None, seed: int = 42, train: float = 0.7, val: float = 0.15, test: float = 0.15) -> DataFrame:
    """rows with their official split, by id and else by path, or else their hash split; split_is_official says which.

    Of a key's splits the last one given counts.
    """
    from lodemark.functions.hashing import hash_split

    hashed = hash_split(F.col("image_id"), seed, train, val, test)
    if official is None:
        return rows.withColumn("split", hashed).withColumn("split_is_official", F.lit(False))
    spark = rows.sparkSession
    keys = spark.createDataFrame([(k, s, i) for i, (k, s) in enumerate(official)], "k string, s string, o long").groupBy(normalize_id(F.col("k")).alias("k")).agg(F.max_by("s", "o").alias("s"))
    out = rows.withColumn("_i", normalize_id(F.col("image_id"))).withColumn("_r", normalize_id(F.col("relative_path")))
    out = out.join(keys.select(F.col("k").alias("_i"), F.col("s").alias("_si")), "_i", "left").join(keys.select(F.col("k").alias("_r"), F.col("s").alias("_sr")), "_r", "left")
    given = F.coalesce("_si", "_sr")
    return out.withColumn("split", F.coalesce(given, hashed)).withColumn("split_is_official", given.isNotNull()).drop("_i", "_r", "_si", "_sr")
