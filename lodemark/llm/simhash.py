"""SimHash near-dedup: fingerprints of whole texts, linked by a tiled exact comparison.

A fingerprint is 64 bits. Distinct fingerprints are laid out in tiles by the population counts of their four 16-bit words
(a sum of differences of those counts is never more than the Hamming distance), so a tile is compared only with tiles whose
counts lie within the radius; a tile pair is one numpy exclusive-or and bit count. Every linked pair is found, and no
all-pairs rows are written: a tile pair gives the edges of a spanning forest of its links.

Two bits are far less than near copies differ in. For those, wide fingerprints of 512 bits of the set of five-word shingles
estimate a Jaccard similarity; they are compared by tiles in the same way, tiles being skipped by the sizes of the sets.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemark.llm.common import components, cut, drop_cut, free, join_hot, session, small_batches

WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
UPPER = bytes(range(65, 91))
LOWERED = bytes.maketrans(UPPER, UPPER.lower())
#: Fingerprints in a tile of the comparison: 64 kB, so a pair of tiles is a small row and 16.8 million comparisons.
TILE = 4096
LAST = (1 << 63) - 1
#: Wide fingerprints, which tell a similarity: words of a shingle, 64-bit words, and fingerprints in a tile (2.4 MB).
SIMILARITY, SIMILAR_SHINGLE, WIDE, WIDE_TILE = 0.8, 5, 8, 32_768
MIX = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x9E3779B97F4A7C15, 0x94D049BB133111EB))


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the shingles of a whole text, repeats included; no words: 0."""
    words = WORDS.findall((text or "").encode("utf-8", "replace").translate(LOWERED))
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, last)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, shingle: int = 3, text: str = "text", name: str = "fp") -> DataFrame:
    """docs with a long column of signed fingerprints."""

    small_batches(session(docs))

    @F.pandas_udf("long")
    def hashed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in s], np.uint64).view(np.int64))

    return docs.withColumn(name, hashed(F.col(text)))


def _forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span every set of fingerprints of a (and b) joined by links between a and b, or inside a if b is None."""
    nodes = a if b is None else np.concatenate((a, b))
    other, shift = (a, 0) if b is None else (b, len(a))
    label = np.arange(len(nodes))
    strip = max(1, (1 << 20) // max(1, len(other)))
    for at in range(0, len(a), strip):
        i, j = np.nonzero(np.bitwise_count(a[at : at + strip, None] ^ other[None, :]) <= radius)
        i, j = i + at, j + shift
        if b is None:
            i, j = i[i < j], j[i < j]
        while len(i):
            x, y = label[i], label[j]
            low = np.minimum(x, y)
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            while (label[label] != label).any():
                label = label[label]
            i, j = i[(apart := label[i] != label[j])], j[apart]
    moved = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[label[moved]]


def _compare(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [_forest(np.frombuffer(x, ">u8").astype(np.uint64), None if y is None else np.frombuffer(y, ">u8").astype(np.uint64), radius) for x, y in zip(pdf["x"], pdf["y"])]
            a, b = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64) for k in (0, 1))
            yield pd.DataFrame({"a": a, "b": b})

    return run


def links(fingerprints: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that join all fingerprints (a long column fp, distinct) linked directly or through others."""
    quarter = lambda c, k: F.bit_count(F.shiftrightunsigned(c, 16 * k).bitwiseAND(F.lit(0xFFFF))).cast("int")
    fps = fingerprints.select("fp", *(quarter(F.col("fp"), k).alias(f"q{k}") for k in range(4)))
    code = lambda q: ((q[0] * 17 + q[1]) * 17 + q[2]) * 17 + q[3]
    fps = fps.withColumn("t", code([F.col(f"q{k}") for k in range(4)]))
    # At most 17^4 = 83,521 tiles whatever the input: a table of two small integers each may be broadcast.
    sizes = fps.groupBy("t").agg(F.ceil(F.count("*") / tile).cast("int").alias("n"))
    dealt = fps.join(F.broadcast(sizes), "t").withColumn("c", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    packed = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list("fp")), lambda x: F.lpad(F.hex(x), 16, "0")), ""))
    tiles = cut(dealt.groupBy("t", "c").agg(packed.alias("x"), *(F.first(f"q{k}").alias(f"q{k}") for k in range(4))), "tiles")
    steps = [(a, b, c, d) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) for c in range(-radius, radius + 1) for d in range(-radius, radius + 1) if abs(a) + abs(b) + abs(c) + abs(d) <= radius and (a, b, c, d) >= (0, 0, 0, 0)]
    near = F.array(*(F.when(F.greatest(*(F.col(f"q{k}") + s[k] for k in range(4)), F.lit(0)).between(0, 16) & (F.least(*(F.col(f"q{k}") + s[k] for k in range(4))) >= 0), code([F.col(f"q{k}") + s[k] for k in range(4)])) for s in steps))
    pairs = (
        tiles.select("t", "c", "x", F.explode(F.array_compact(near)).alias("ot"))
        .join(F.broadcast(sizes.select(F.col("t").alias("ot"), F.col("n").alias("on"))), "ot")
        .withColumn("oc", F.explode(F.sequence(F.lit(0), F.col("on") - 1)))
        .where("ot <> t or oc > c")
        .join(tiles.select(F.col("t").alias("ot"), F.col("c").alias("oc"), F.col("x").alias("y")), ["ot", "oc"])
        .select("x", "y")
    )
    return pairs.union(tiles.select("x", F.lit(None).cast("binary"))).mapInPandas(_compare(radius), "a long, b long")


def _grouped(docs: DataFrame, shingle: int, radius: int, id_col: str, text_col: str) -> DataFrame:
    """One row per row of docs: doc_id, h (hash of the text), fp, component_id, and root, which names the component."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = cut(with_fingerprint(rows, shingle).select("doc_id", F.xxhash64("text").alias("h"), "fp"), "fingerprints")
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("often")).withColumn("node", F.col("fp")), "classes")
    return _named(marked, classes, links(classes.select("fp"), radius))


def _named(marked: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """marked with root and component_id (the least id) of the component that edges join its class (fp, node) to."""
    linked = cut(components(edges), "components")
    of_class = classes.join(linked, "node", "left").select("fp", "least", "often", F.coalesce("root", "node").alias("root"))
    of_class = cut(of_class, "roots")
    named = linked.select("root").distinct().join(of_class, "root").groupBy("root").agg(F.min("least").alias("smallest"))
    names = cut(of_class.join(named, "root", "left").select("fp", "root", "often", F.coalesce("smallest", "least").alias("component_id")), "names")
    drop_cut(linked)
    drop_cut(of_class)
    drop_cut(classes)
    return join_hot(marked, names, "fp", "often")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, fingerprint (16 hex digits) and component_id, the smallest id it is linked to.

    Links: fingerprints at radius or fewer differing bits, equal ones included. Null and empty texts have fingerprint 0 and
    link like any other; texts of any length are hashed whole. A null id is in its group but never names it (null
    component_id if no id of the group is set). Repeated rows come out as often as they went in. An empty table gives an
    empty table. Other columns are not looked at.
    """
    return _grouped(docs, shingle, radius, id_col, text_col).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


class _Hashes(dict):
    """XXH64 of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 42)
        if len(self) < 500_000:
            self[word] = h
        return h


def wide_fingerprint(text: str | None, shingle: int = SIMILAR_SHINGLE, words: int = WIDE, known: dict | None = None) -> tuple[int, np.ndarray]:
    """How many distinct shingles a text has, and a SimHash of that set in `words` 64-bit words.

    A text of fewer words is one shingle; without words there is none, and all bits are 0.
    """
    split = WORDS.findall((text or "").encode("utf-8", "replace").translate(LOWERED))
    if not split:
        return 0, np.zeros(words, np.uint64)
    known = _Hashes() if known is None else known
    each = np.fromiter(map(known.__getitem__, split), np.uint64, len(split))
    n = max(1, len(each) - shingle + 1)
    h = each[:n].copy()
    for j in range(1, min(shingle, len(each))):
        h = (h ^ (h >> np.uint64(29))) * MIX[0] + each[j : j + n]
    h = np.unique(h)
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(h), 255):
        z = h[at : at + 255, None] + np.arange(1, words + 1, dtype=np.uint64) * MIX[1]
        z = (z ^ (z >> np.uint64(30))) * MIX[0]
        z = (z ^ (z >> np.uint64(27))) * MIX[2]
        z ^= z >> np.uint64(31)
        # sums of 255 bits fit a byte
        ones += np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return len(h), np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)


def allowed_bits(a, b, similarity: float, bits: int, deviations: float = 1) -> np.ndarray:
    """Bits that may differ between the wide fingerprints of sets of a and b shingles.

    Each bit differs with the probability angle / pi, for the angle between the sets as vectors, which their sizes and a
    Jaccard similarity fix; as many bits as sets of just that similarity differ in, and so many standard deviations more.
    """
    a, b = np.maximum(a, 1).astype(float), np.maximum(b, 1).astype(float)
    p = np.arccos(np.minimum(similarity * (a + b) / ((1 + similarity) * np.sqrt(a * b)), 1.0)) / np.pi
    return np.floor(bits * p + deviations * np.sqrt(bits * p * (1 - p)))


def _similar_forest(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray] | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges, as positions in a and then b, that span all sets joined by links between a and b, or inside a if b is None.

    a and b are (sizes, fingerprints). Blocks of the tiles are compared by their first word, which links let differ by 5
    standard deviations at most; what is left, and isn't joined yet, by all words.
    """
    sizes, fps = a if b is None else (np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1])))
    low = 0 if b is None else len(a[0])
    label, columns = np.arange(len(fps)), 4096
    first = int(allowed_bits(np.ones(1), np.ones(1), similarity, 64, 5)[0])
    for at in range(0, len(a[0]), 64):
        head = fps[at : at + 64, 0]
        for to in range(low or at, len(fps), columns):
            i, j = np.nonzero(np.bitwise_count(head[:, None] ^ fps[None, to : to + columns, 0]) <= first)
            i, j = i + at, j + to
            keep = (label[i] != label[j]) & (sizes[i] >= similarity * sizes[j]) & (sizes[j] >= similarity * sizes[i])
            if b is None:
                keep &= i < j
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            apart = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int64) <= allowed_bits(sizes[i], sizes[j], similarity, 64 * fps.shape[1])
            i, j = i[apart], j[apart]
            while len(i):
                x, y = label[i], label[j]
                least = np.minimum(x, y)
                np.minimum.at(label, x, least)
                np.minimum.at(label, y, least)
                while (label[label] != label).any():
                    label = label[label]
                i, j = i[(rest := label[i] != label[j])], j[rest]
    moved = np.nonzero(label != np.arange(len(fps)))[0]
    return moved, label[moved]


def _compare_similar(similarity: float, words: int):
    def unpack(packed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.frombuffer(packed, np.uint8).reshape(-1, 12 + 8 * words)
        return rows[:, :8].copy().view(">i8")[:, 0].astype(np.int64), rows[:, 8:12].copy().view(">u4")[:, 0].astype(np.int64), rows[:, 12:].copy().view(np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x, y in zip(pdf["x"], pdf["y"]):
                a, b = unpack(x), None if y is None else unpack(y)
                nodes = a[0] if b is None else np.concatenate((a[0], b[0]))
                i, j = _similar_forest(a[1:], None if b is None else b[1:], similarity)
                yield pd.DataFrame({"a": nodes[i], "b": nodes[j]})

    return run


def similar_links(classes: DataFrame, similarity: float = SIMILARITY, words: int = WIDE, tile: int = WIDE_TILE) -> DataFrame:
    """Edges (a, b) of nodes that join all classes (node long, fp: 4 bytes of size and the wide fingerprint) linked directly or through others.

    A tile holds sets of about one size. Sets whose sizes, the population counts of their shingles, differ by more than the
    similarity allows can't have it, so tile pairs that far apart are skipped; a pair of tiles meets in one row and gives
    the edges of a spanning forest.
    """
    steps = 4
    size = F.conv(F.hex(F.substring("fp", 1, 4)), 16, 10).cast("long")
    rows = classes.select("node", "fp", size.alias("size")).where("size > 0").withColumn("t", F.floor(F.log("size") * (steps / -math.log(similarity))).cast("int"))
    # a row for each class of sizes: at most 4 * ln(2^32) / ln(1 / similarity), 398 at 0.8
    sizes = rows.groupBy("t").agg(F.ceil(F.count("*") / tile).cast("int").alias("n"))
    dealt = rows.join(F.broadcast(sizes), "t").withColumn("c", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    each = F.concat(F.lpad(F.hex("node"), 16, "0"), F.hex("fp"))
    packed = F.unhex(F.array_join(F.array_sort(F.collect_list("e")), ""))
    tiles = cut(dealt.select("t", "c", each.alias("e")).groupBy("t", "c").agg(packed.alias("x")), "tiles")
    # floors of numbers that differ by `steps` at most differ by that much or one more, for rounding
    pairs = (
        tiles.select("t", "c", "x", F.explode(F.sequence(F.col("t"), F.col("t") + steps + 1)).alias("ot"))
        .join(F.broadcast(sizes.select(F.col("t").alias("ot"), F.col("n").alias("on"))), "ot")
        .withColumn("oc", F.explode(F.sequence(F.lit(0), F.col("on") - 1)))
        .where("ot > t or oc > c")
        .join(tiles.select(F.col("t").alias("ot"), F.col("c").alias("oc"), F.col("x").alias("y")), ["ot", "oc"])
        .select("x", "y")
    )
    return pairs.union(tiles.select("x", F.lit(None).cast("binary"))).mapInPandas(_compare_similar(similarity, words), "a long, b long")


def _similar(docs: DataFrame, similarity: float, shingle: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """One row per row of docs: doc_id, h (hash of the text), fp (size and wide fingerprint), component_id and root."""
    small_batches(session(docs))

    @F.pandas_udf("binary")
    def hashed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Hashes()
        for s in texts:
            found = [wide_fingerprint(t, shingle, words, known) for t in s]
            yield pd.Series([n.to_bytes(4, "big") + x.tobytes() for n, x in found], dtype=object)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = cut(rows.select("doc_id", F.xxhash64("text").alias("h"), hashed("text").alias("fp")), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("often"))
    # written, so that a class's number never changes again
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    return _named(marked, classes, similar_links(classes, similarity, words))


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SIMILAR_SHINGLE, words: int = WIDE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, shingles (how many distinct ones its text has) and component_id, the smallest id linked.

    Links: sets of five-word shingles that by their fingerprints of 512 bits have the Jaccard similarity or more (see
    allowed_bits: one of just 0.8 is found five times in six, of 0.85 practically always; one of 0.65 practically never).
    Null and empty texts are one group; texts of any length count whole. Nulls and repeats as in near_duplicates.
    """
    grouped = _similar(docs, similarity, shingle, words, id_col, text_col)
    return grouped.select("doc_id", F.conv(F.hex(F.substring("fp", 1, 4)), 16, 10).cast("long").alias("shingles"), "component_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SIMILAR_SHINGLE, words: int = WIDE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies: of each group of similar_groups one row stays, that with the smallest id.

    Rows are told apart by id and text, so an id that stands for two texts is two documents; of those with the group's
    smallest id, the one with the smallest hash stays, and of rows alike in both any one. A row with a null id stays only
    where no id of its group is set. Extra columns stay as they are, whatever their names.
    """
    grouped = _similar(docs, similarity, shingle, words, id_col, text_col)
    rows = cut(grouped.select("doc_id", "h", "root", "component_id"), "grouped")
    named = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # groups of one row are no news; the others' named rows are few, and only those are shuffled
    first = rows.where(named).groupBy("root").agg(F.min("h").alias("first"))
    mine = rows.where(named).join(first, "root").where("h <> first").select("doc_id", "h")
    d, null, h = on = free(docs.columns, "d", "null", "h")
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias(d), F.col("doc_id").isNull().alias(null), F.col("h").alias(h)]
    gone = cut(rows.where(~named).select("doc_id", "h").union(mine).select(*key).distinct(), "gone")
    often = cut(rows.where(named).select(*key).groupBy(*on).count().where("count > 1").drop("count"), "often")
    drop_cut(rows)
    marked = docs.withColumns({d: F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), null: F.col(id_col).isNull(), h: F.xxhash64(text_col)})
    left = marked.join(gone, on, "left_anti")
    if not often.isEmpty():
        left = left.join(often, on, "left_anti").unionByName(left.join(often, on, "left_semi").dropDuplicates(on))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
