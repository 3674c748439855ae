"""Leakage between a dataset A and a knowledge base: equal files, near fingerprints, shared captions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemark.functions.hashing import hamming64, hex_to_long
from lodemark.functions.text import normalize_caption


#: Bits of a band at least, partners of a band value in a task, and fingerprints of a tile (64 kB).
BAND_BITS, BAND_ROWS, TILE = 8, 10_000, 8192
#: Fingerprints of a tile that are compared at once with eight times as many, pairs of fingerprints in a task, and tasks at least.
STEP, TASK_PAIRS, LEAST_TASKS = 256, 1 << 31, 24


def _ordered(value: Column) -> Column:
    """A group's ids in manifest order; an id comes as often as the value does."""
    return F.transform(F.array_sort(F.collect_list(F.struct("ordinal", value.alias("id")))), lambda s: s["id"])


def hard_matches(a: DataFrame, kb: DataFrame) -> DataFrame:
    """Images of a whose bytes are those of images of kb: image_id, split, kb_image_ids, sha256.

    a and kb have image_id, sha256 and ordinal, a split too; empty digests match nothing. kb is grouped before the join, so
    a digest that many rows share is one row.
    """
    held = kb.where(F.col("sha256") != "").groupBy("sha256").agg(_ordered(F.col("image_id")).alias("kb_image_ids"))
    return a.where(F.col("sha256") != "").join(held, "sha256").select("image_id", "split", "kb_image_ids", "sha256")


def _banded(left: DataFrame, right: DataFrame, threshold: int, bits: int) -> DataFrame:
    """Pairs (_x, _y) that agree on one of threshold + 1 bands at least, each once: in the first band it agrees on.

    A band value's partners are dealt over as many salts as leave about BAND_ROWS of the right side in each.
    """
    bands = threshold + 1
    edges = [bits * k // bands for k in range(bands + 1)]
    mask = lambda k: -1 if edges[k + 1] - edges[k] == 64 else (1 << (edges[k + 1] - edges[k])) - 1
    salts = max(1, -(-right.count() // ((1 << bits // bands) * BAND_ROWS)))
    cut = lambda c: F.array(*(F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(c, edges[k]).bitwiseAND(F.lit(mask(k))).alias("v")) for k in range(bands)))
    x = left.select("_x", F.explode(cut(F.col("_x"))).alias("e")).select("_x", "e.k", "e.v", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"))
    y = right.select("_y", F.explode(cut(F.col("_y"))).alias("e"), F.pmod(F.xxhash64("_y"), F.lit(salts)).cast("int").alias("s")).select("_y", "e.k", "e.v", "s")
    differs = F.col("_x").bitwiseXOR(F.col("_y"))
    earlier = F.lit(False)
    for k in range(bands):
        agrees = F.shiftrightunsigned(differs, edges[k]).bitwiseAND(F.lit(mask(k))) == 0
        earlier = earlier | (agrees & (F.col("k") > k))
    return x.join(y, ["k", "v", "s"]).where((hamming64(F.col("_x"), F.col("_y")) <= threshold) & ~earlier).select("_x", "_y")


def _tiled(left: DataFrame, right: DataFrame, threshold: int) -> DataFrame:
    """Pairs (_x, _y) by comparing tiles of TILE fingerprints of one bit count, where bit counts allow it.

    A pair of tiles is one row of packed numbers and one exclusive-or in numpy; only near pairs come out.
    """

    def tiles(rows: DataFrame, c: str) -> tuple[DataFrame, DataFrame, dict]:
        rows = rows.select(F.col(c), F.bit_count(c).cast("int").alias("t"))
        # a row for each bit count: 65 at most
        counts = {r["t"]: r["n"] for r in rows.groupBy("t").agg(F.count("*").alias("n")).collect()}
        sizes = rows.sparkSession.createDataFrame([(t, -(-n // TILE)) for t, n in counts.items()], "t int, n int")
        dealt = rows.join(F.broadcast(sizes), "t").withColumn("p", F.pmod(F.xxhash64(c), F.col("n")).cast("int"))
        return dealt.groupBy("t", "p").agg(F.collect_list(c).alias(c)), sizes, counts

    def near(batches):
        for pdf in batches:
            for a, b in zip(pdf["_x"], pdf["_y"]):
                a, b = np.asarray(a, np.int64).view(np.uint64), np.asarray(b, np.int64).view(np.uint64)
                for at in range(0, len(a), STEP):
                    for to in range(0, len(b), 8 * STEP):
                        i, j = np.nonzero(np.bitwise_count(a[at : at + STEP, None] ^ b[None, to : to + 8 * STEP]) <= threshold)
                        if len(i):
                            yield pd.DataFrame({"_x": a[i + at].view(np.int64), "_y": b[j + to].view(np.int64)})

    (x, _, many), (y, sizes, more) = tiles(left, "_x"), tiles(right, "_y")
    work = sum(n * m for t, n in many.items() for u, m in more.items() if abs(t - u) <= threshold)
    other = x.select("_x", F.explode(F.sequence(F.greatest(F.col("t") - threshold, F.lit(0)), F.col("t") + threshold)).alias("t"))
    other = other.join(F.broadcast(sizes), "t").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pairs = other.join(y, ["t", "p"]).select("_x", "_y")
    # dealt by number: few bytes are much work here, and adaptive execution would put pairs of tiles together by their bytes
    pairs = pairs.repartition(max(LEAST_TASKS, -(-work // TASK_PAIRS)), F.get("_x", F.lit(0)), F.get("_y", F.lit(0)))
    return pairs.mapInPandas(near, "_x long, _y long")


def hamming_join(a: DataFrame, b: DataFrame, threshold: int, a_hash: str = "ha", b_hash: str = "hb", bits: int = 64) -> DataFrame:
    """All pairs of a and b whose long fingerprints differ in threshold bits at most, with column hamming.

    Pigeonhole: two such fingerprints agree on one of threshold + 1 bands at least, so pairs are found by equal bands. Bands
    too narrow to tell fingerprints apart (below BAND_BITS) give way to tiles, compared in numpy. Both lose no pair.
    Distinct fingerprints are joined and rows put back after, so copies don't multiply candidates. Null fingerprints match
    nothing.
    """
    left = a.where(F.col(a_hash).isNotNull()).select(F.col(a_hash).alias("_x")).distinct()
    right = b.where(F.col(b_hash).isNotNull()).select(F.col(b_hash).alias("_y")).distinct()
    pairs = _banded(left, right, threshold, bits) if bits // (threshold + 1) >= BAND_BITS else _tiled(left, right, threshold)
    pairs = pairs.select("_x", "_y", hamming64(F.col("_x"), F.col("_y")).alias("hamming"))
    return a.join(pairs, F.col(a_hash) == F.col("_x")).join(b, F.col(b_hash) == F.col("_y")).drop("_x", "_y")


def soft_matches(a: DataFrame, kb: DataFrame, threshold: int = 5) -> DataFrame:
    """Pairs of near fingerprints (dhash64, hex): image_id, split, kb_image_id, hamming, already_hard_match.

    The last is about the image of a alone: whether it has a hard match with any image of kb.
    """
    hard = hard_matches(a, kb).select("image_id").distinct().withColumn("_hard", F.lit(True))
    left = a.select("image_id", "split", hex_to_long(F.col("dhash64")).alias("ha"))
    right = kb.select(F.col("image_id").alias("kb_image_id"), hex_to_long(F.col("dhash64")).alias("hb"))
    return hamming_join(left, right, threshold).join(hard, "image_id", "left").select("image_id", "split", "kb_image_id", "hamming", F.coalesce("_hard", F.lit(False)).alias("already_hard_match"))


def captions_of(rows: DataFrame) -> DataFrame:
    """One row per caption: image_id, ordinal, caption."""
    return rows.select("image_id", "ordinal", F.explode("captions").alias("caption"))


def caption_overlap(a: DataFrame, kb: DataFrame, normalized: bool = False, shown: int = 20, compose: bool = False) -> DataFrame:
    """Captions that both have, one row each: the caption and the first ids of either side, an id for each occurrence.

    normalized: by normalised text, empty ones left out.
    """
    name = "normalized_caption" if normalized else "caption"

    def index(rows: DataFrame, ids: str) -> DataFrame:
        texts = captions_of(rows)
        if normalized:
            # each text is normalised once, however many rows have it
            known = texts.select("caption").distinct().withColumn(name, normalize_caption(F.col("caption"), compose)).where(F.col(name) != "")
            texts = texts.join(known, "caption")
        return texts.groupBy(name).agg(F.slice(_ordered(F.col("image_id")), 1, shown).alias(ids))

    return index(a, "image_ids").join(index(kb, "kb_image_ids"), name)


def audit(a: DataFrame, kb: DataFrame, threshold: int = 5, exact: bool = True, normalized: bool = True, preview: int = 50) -> dict:
    """Counts, warnings and previews of all leakage between a and kb."""
    hard, soft = hard_matches(a, kb), soft_matches(a, kb, threshold)
    overlap = caption_overlap(a, kb) if exact else None
    normal = caption_overlap(a, kb, normalized=True, compose=True) if normalized else None
    n = hard.agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t")).first()
    m = soft.agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t"), F.count_if(~F.col("already_hard_match")).alias("new")).first()
    counts = {"hard_image_matches": n["n"], "hard_image_matches_test": n["t"], "soft_image_matches": m["n"], "soft_image_matches_test": m["t"], "soft_image_matches_new": m["new"], "exact_caption_overlaps": overlap.count() if exact else 0, "normalized_caption_overlaps": normal.count() if normalized else 0, "a_images": a.count(), "kb_images": kb.count()}
    names = {"hard_image_matches": "images of A are in the knowledge base byte for byte", "hard_image_matches_test": "test images are in the knowledge base", "exact_caption_overlaps": "captions are in both"}
    head = lambda df, *by: [r.asDict(recursive=True) for r in df.orderBy(*by).limit(preview).collect()] if df is not None else []
    return {"counts": counts, "warnings": [f"{counts[k]} {what}" for k, what in names.items() if counts[k]], "hard": head(hard, "image_id"), "soft": head(soft, "image_id", "kb_image_id"), "exact": head(overlap, "caption"), "normalized": head(normal, "normalized_caption")}


def gate(counts: dict, fail_on: dict[str, bool]) -> tuple[str, list[str]]:
    """PASS, or FAIL with the counters that are asked to be zero and aren't."""
    failed = [k for k, wanted in fail_on.items() if wanted and counts.get(k, 0) > 0]
    return ("FAIL" if failed else "PASS"), failed
