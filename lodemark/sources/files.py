"""Image files, and lookups of single files, on any file system that Spark reaches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemark.functions.hashing import dhash_of_image

EXTENSIONS = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp", ".webp")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def scratch_folder(spark: SparkSession, what: str) -> str:
    """A fresh path that all executors share: in spark.checkpoint.dir, or a temporary one where all is one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.split("-")[0].startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        folder = "file://" + tempfile.mkdtemp(prefix="lodemark-")
    return f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file, on any file system that Spark reaches."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder."""
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text: annotations, splits and configurations."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def qualified(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    return fs.makeQualified(p).toString()


def find_first(spark: SparkSession, root: str, candidates: list[str], folders: tuple[str, ...] = ("",)) -> str | None:
    """The first candidate there is, in the first folder that has one."""
    for folder in folders:
        for name in candidates:
            path = "/".join(x for x in (root.rstrip("/"), folder.strip("/"), name) if x)
            if exists(spark, path):
                return path
    return None


def scan_images(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, skipped: str | None = "caption", content: bool = True, base: str | None = None) -> DataFrame:
    """image_path, relative_path (below base, else root), file_size_bytes and content of the images under root.

    Suffixes count in any case; files below a folder called `skipped` (in any case, inside root) are left out. Hidden files
    and folders, which Spark's readers pass over, don't count. Manifests are put in order when they are written.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    above = _clean(qualified(spark, base or root)).rstrip("/")
    clean = F.regexp_replace("path", r"^(\w+):/+", "$1:/")
    relative = F.substring(clean, F.lit(len(above) + 2), F.length("path"))
    rows = files.select(F.col("path").alias("image_path"), relative.alias("relative_path"), F.col("length").alias("file_size_bytes"), *(["content"] if content else []))
    rows = rows.where(F.lower("relative_path").rlike("(" + "|".join(e.lower().replace(".", r"\.") for e in extensions) + ")$"))
    if skipped:
        rows = rows.where(~F.array_contains(F.split(F.lower("relative_path"), "/"), skipped.lower()))
    return rows


def _clean(path: str) -> str:
    import re

    return re.sub(r"^(\w+):/+", r"\1:/", path)


def first_root(spark: SparkSession, root: str, folders: tuple[str, ...] = ("images", "Images", ""), extensions: tuple[str, ...] = EXTENSIONS) -> str:
    """The first of the folders under root that holds an image; root if none does."""
    for folder in folders:
        path = f"{root.rstrip('/')}/{folder}".rstrip("/")
        if exists(spark, path) and not scan_images(spark, path, extensions, None, content=False).isEmpty():
            return path
    return root


def decoded_images(spark: SparkSession, root: str) -> DataFrame:
    """image_path and image (height, width, nChannels, data: rows of blue, green, red bytes) of what can be decoded under root."""
    rows = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", True).load(root)
    return rows.select(F.col("image.origin").alias("image_path"), F.struct("image.height", "image.width", "image.nChannels", "image.data").alias("image"))


def inspect(spark: SparkSession, images: DataFrame, root: str) -> DataFrame:
    """images with sha256, width, height, dhash64, ok and error.

    An image that can't be decoded keeps its digest and has size 0, no fingerprint and an error, `Type: message`. Digests
    are the JVM's and decoding Spark's image source (which has no decoder for webp), so bytes never meet in a shuffle;
    only the fingerprint runs in Python.
    """
    decoded = spark.read.format("image").option("recursiveFileLookup", "true").load(root).select("image.*").select(
        F.regexp_replace("origin", r"^(\w+):/+", "$1:/").alias("_p"), F.greatest("width", F.lit(0)).alias("width"), F.greatest("height", F.lit(0)).alias("height"),
        dhash_of_image(F.struct("height", "width", "nChannels", "data")).alias("dhash64"),
    )
    rows = images.withColumn("_p", F.regexp_replace("image_path", r"^(\w+):/+", "$1:/")).withColumn("sha256", F.sha2("content", 256)).drop("content")
    out = rows.join(decoded, "_p", "left")
    ok = F.coalesce(F.col("width") > 0, F.lit(False))
    error = F.format_string("UnidentifiedImageError: cannot identify image file '%s'", F.regexp_replace("_p", r"^file:", ""))
    return out.withColumn("ok", ok).withColumn("error", F.when(ok, "").otherwise(error)).drop("_p").na.fill({"width": 0, "height": 0, "dhash64": ""})
