"""Text as Column expressions: normalisation, tokens, identifiers and path parts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Captions, and bytes of them, that a Python worker gets at once.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20
#: White space as str.split() and str.strip() see it.
SPACE = r"(?U)[\s\x1c-\x1f]"
#: Runs of what is neither letter, digit nor underscore: punctuation and white space.
BETWEEN = r"[^\p{L}\p{N}_]+"


def strip(c: Column) -> Column:
    """c without white space of any kind at its ends (trim() takes spaces alone)."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def words(c: Column) -> Column:
    """The runs of anything but white space; none in an empty or blank text."""
    return F.filter(F.split(c, SPACE + "+"), lambda w: w != "")


def nfkc(c: Column) -> Column:
    """Compatibility composition, for which Spark has no function.

    Arrow batches of the session become small: 10,000 long captions at once, and their composed copies, fill a Python worker.
    """
    spark = SparkSession.active()
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    @F.pandas_udf(T.StringType())
    def composed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    # texts of ASCII alone are composed as they stand, and never leave the JVM
    return F.when(c.rlike(r"[^\x00-\x7f]"), composed(F.when(c.rlike(r"[^\x00-\x7f]"), c))).otherwise(c)


def normalize_caption(c: Column, compose: bool = False) -> Column:
    """Lower case, punctuation to spaces, white space squeezed; null gives ''. compose: with NFKC first, in Python.

    Without it the expression stays in the JVM and is right wherever NFKC changes nothing.
    """
    c = F.coalesce(c, F.lit(""))
    c = nfkc(c) if compose else c
    return F.trim(F.regexp_replace(F.lower(c), BETWEEN, " "))


def token_set(normalized: Column) -> Column:
    """Distinct words of a normalised caption."""
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda t: t != ""))


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - |a ∩ b| / |a ∪ b| of token sets; 0 for two empty ones."""
    both = F.size(a) + F.size(b)
    # a lambda's variable, as inside another lambda an expression is worked out wherever it stands
    distance = lambda n: F.when(both == 0, F.lit(0.0)).otherwise(1.0 - n / (both - n))
    return F.get(F.transform(F.array(F.size(F.array_intersect(a, b))), distance), F.lit(0))


def basename(c: Column) -> Column:
    return F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), -1)


def stem(c: Column) -> Column:
    """The base name without its last suffix; a name that begins with its only dot is all stem."""
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]+$", "")


def normalize_id(c: Column) -> Column:
    """The stem of an id or path without outer white space, as split files name their records."""
    return stem(strip(c))


def class_of(relative: Column, skipped: tuple[str, ...] = ("images", "image", "imgs", "img")) -> Column:
    """The first folder of a relative path that isn't just a folder for images; '' if there is none."""
    parts = F.split(relative, "/")
    folders = F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda p: ~F.lower(p).isin(*skipped))
    return F.coalesce(F.get(folders, F.lit(0)), F.lit(""))


def caption_id(owner: Column, index: Column) -> Column:
    return F.format_string("%s::caption::%02d", owner, index)
