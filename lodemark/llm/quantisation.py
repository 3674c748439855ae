"""Nearest neighbours by cosine through additive quantisation, with exact reranking.

A unit vector is coded as the sum of one full-dimensional codeword from each of several codebooks. Codebooks begin as
k-means of the residuals left by those before and are then fitted to each other by least squares; codes are found by beam
search. The index keeps a vector's codes, the stored norm of its approximation and its distance from it, so a query scores
every vector by adding up looked-up dot products. The best are scored again, and so is every vector whose approximation is
not too far off to rule it out; the best of those are scored on the original vectors, in double precision.
Vectors of one direction (to twelve digits) are one entry of the index and keep the few smallest ids that any answer can
need, so neither copies nor multiples of a vector crowd out anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodemark.llm.common import buckets_for, cut, drop_cut, hashed_sample, session

BOOKS, WORDS, BEAM = 16, 256, 4
#: About so many vectors fit the codebooks: those with the smallest hashes.
FIT_ROWS = 32_768
#: Entries that are scored exactly for each query and batch of codes, to know the score to beat.
RERANK = 320
#: Queries that are broadcast at once (float32: 1 MB at 64 dimensions), and codes that a task scans.
QUERY_BLOCK, SCAN_ROWS = 4096, 65_536
#: Queries that meet a batch of codes at once, what looked-up scores may be off by rounding, and scores that may be ties.
QUERY_CHUNK, LOOKUP_ERROR, SAME = 128, 1e-4, 1e-10
#: Digits to which directions and scores are told apart.
DIGITS = 12


@dataclass
class Codebooks:
    words: np.ndarray  # (books, words, dimensions), float32

    def __post_init__(self):
        flat = self.words.reshape(-1, self.words.shape[2])
        self.gram = flat @ flat.T
        self.own = np.diag(self.gram).copy()

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes (n, books) of the vectors, the best of a beam search."""
        return np.concatenate([self._encode(x[at : at + 1024], beam) for at in range(0, len(x), 1024)] or [np.zeros((0, len(self.words)), np.uint8)])

    def _encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        books, words, _ = self.words.shape
        n = len(x)
        dots = x @ self.words.reshape(books * words, -1).T
        own = self.own
        codes, error = np.zeros((n, 1, books), np.int64), np.zeros((n, 1), np.float32)
        for m in range(books):
            part = slice(m * words, (m + 1) * words)
            total = error[:, :, None] + (own[part] - 2 * dots[:, part])[:, None, :]
            for j in range(m):
                total = total + 2 * self.gram[j * words + codes[:, :, j], part]
            total = total.reshape(n, -1)
            keep = min(beam, total.shape[1])
            best = np.argpartition(total, keep - 1, axis=1)[:, :keep]
            error = np.take_along_axis(total, best, 1)
            codes = np.take_along_axis(codes, (best // words)[:, :, None], 1)
            codes[:, :, m] = best % words
        first = error.argmin(axis=1)
        return codes[np.arange(n), first].astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m][codes[:, m]] for m in range(len(self.words)))


def _k_means(x: np.ndarray, k: int, draw: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centre = x[draw.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (2 * x @ centre.T - (centre * centre).sum(axis=1)).argmax(axis=1)
        count = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, d], k) for d in range(x.shape[1])], axis=1)
        centre = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], x[draw.integers(len(x), size=k)]).astype(np.float32)
    return centre


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 2, seed: int = 42) -> Codebooks:
    """Codebooks of unit vectors (n, d), n of 1 at least."""
    draw, rest, found = np.random.default_rng(seed), x.astype(np.float32), []
    for _ in range(books):
        centre = _k_means(rest, words, draw)
        rest = rest - centre[(2 * rest @ centre.T - (centre * centre).sum(axis=1)).argmax(axis=1)]
        found.append(centre)
    out = Codebooks(np.stack(found))
    x = x.astype(np.float32)
    for _ in range(rounds):
        codes = out.encode(x, 4)
        fitted = out.words.copy()
        rest = x - out.decode(codes)
        # least squares one codebook at a time: a word is the mean of what the others leave of its vectors
        for m in [*range(books)] * 3:
            rest += fitted[m][codes[:, m]]
            count = np.bincount(codes[:, m], minlength=words)
            sums = np.stack([np.bincount(codes[:, m], rest[:, d], words) for d in range(x.shape[1])], axis=1)
            fitted[m] = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], fitted[m])
            rest -= fitted[m][codes[:, m]]
        out = Codebooks(fitted)
    return out


def _scaled(column) -> np.ndarray:
    """Vectors as doubles, each divided by a power of two that brings its largest component near 1: nothing else changes."""
    x = np.stack([np.asarray(v, np.float64) for v in column])
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _unit(column) -> np.ndarray:
    x = _scaled(column)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _encoder(books):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                unit = _unit(pdf["unit"])
                codes = books.value.encode(unit.astype(np.float32))
                near = books.value.decode(codes)
                off = np.sqrt(((unit - near) ** 2).sum(axis=1))
                yield pd.DataFrame({"c": pdf["c"], "codes": [r.tobytes() for r in codes], "norm": (near * near).sum(axis=1), "off": off, "unit": [r.tobytes() for r in unit]})

    return run


def _scanner(books, queries, rerank: int, k: int):
    """For each query the k + 1 best entries of a task, and all as good to the last digits: its own may be one of them.

    Looked-up scores give a short list, and that a score to beat. By the triangle inequality an entry as far from its
    approximation as `off` can't beat it if the approximation is farther from the query by more than that; all others are
    scored exactly.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n_books, words, _ = books.value.words.shape
        ask, exact = queries.value[1], queries.value[4]
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(ask)

        def keep(i: int, score: np.ndarray, c: np.ndarray) -> None:
            score, c = np.concatenate((best[i][0], score)), np.concatenate((best[i][1], c))
            if len(score) > k + 1:
                there = score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1] - SAME
                score, c = score[there], c[there]
            best[i] = score, c

        for pdf in batches:
            if not len(pdf):
                continue
            codes = np.frombuffer(b"".join(pdf["codes"]), np.uint8).reshape(-1, n_books).astype(np.int64)
            norm, c, off = pdf["norm"].to_numpy(np.float32) / 2, pdf["c"].to_numpy(np.int64), pdf["off"].to_numpy(np.float64)
            unit = np.frombuffer(b"".join(pdf["unit"])).reshape(len(c), -1)
            for at in range(0, len(ask), QUERY_CHUNK):
                part = range(at, min(at + QUERY_CHUNK, len(ask)))
                left = []
                for i in part:
                    table = books.value.words @ ask[i]
                    s = -norm
                    for m in range(n_books):
                        s = s + table[m][codes[:, m]]
                    top = np.argpartition(-s, rerank - 1)[:rerank] if len(s) > rerank else np.arange(len(s))
                    score = unit[top] @ exact[i]
                    if len(top) == len(s):
                        keep(i, score, c[top])
                        left.append(top[:0])
                        continue
                    known = np.concatenate((best[i][0], score))
                    beat = np.partition(known, len(known) - k - 1)[len(known) - k - 1] - SAME if len(known) > k else -2.0
                    keep(i, score[score >= beat], c[top[score >= beat]])
                    open_ = s >= (1 - (np.sqrt(max(0.0, 2 - 2 * beat)) + off) ** 2) / 2 - LOOKUP_ERROR
                    open_[top] = False
                    left.append(np.nonzero(open_)[0])
                # many left: one product of matrices is cheaper than vector by vector
                whole = exact[part.start : part.stop] @ unit.T if sum(map(len, left)) > 0.05 * len(part) * len(c) else None
                for j, i in enumerate(part):
                    if len(left[j]):
                        score = whole[j][left[j]] if whole is not None else unit[left[j]] @ exact[i]
                        least = best[i][0].min() - SAME if len(best[i][0]) > k else -2.0
                        keep(i, score[score >= least], c[left[j][score >= least]])
        if sum(len(x) for x, _ in best):
            q = np.repeat(np.arange(len(ask)), [len(x) for x, _ in best])
            yield pd.DataFrame({"q": q, "c": np.concatenate([x for _, x in best]), "s": np.concatenate([x for x, _ in best])})

    return run


def _reranker(queries):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, _, raw, own, _ = queries.value
        length = np.sqrt((raw * raw).sum(axis=1))
        for pdf in batches:
            pdf = pdf[own[pdf["q"].to_numpy(np.int64)] != pdf["row"].to_numpy(np.int64)]
            if len(pdf):
                x = _scaled(pdf["embedding"])
                q = pdf["q"].to_numpy(np.int64)
                score = (raw[q] * x).sum(axis=1) / (length[q] * np.sqrt((x * x).sum(axis=1)))
                yield pd.DataFrame({"q": q, "query_id": ids[q], "vec_id": pdf["vec_id"], "row": pdf["row"], "score": score})

    return run


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the rows that take part: with an id, of the commonest dimension, finite and not zero."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null").where(fine)
    size = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("embedding") == (size["d"] if size else 0))


def _with_unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            # no negative zeros: directions are compared
            yield pdf.assign(unit=list(np.round(_unit(pdf["embedding"]), DIGITS) + 0.0))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, rerank: int = RERANK, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The k nearest found of each row whose vec_id is divisible by `every`: query_id, rank, vec_id, score (cosine).

    Rows with a null id, a null, zero or non-finite vector, or another dimension than most take no part; finite components
    of any size count. What the codes can't rule out is scored exactly, so none of the nearest is missed, however many lie
    within the codes' error; `rerank` is the length of the short list alone. Scores equal to DIGITS digits are ties and go to the smaller vec_id, so multiples of a vector come
    in order of their ids. Every row is a candidate of all others: a row repeated, or of the same id, too. An empty table
    gives an empty one; extra columns are not looked at. Queries run in blocks of about QUERY_BLOCK, each broadcast and
    scanned against the whole index, each block's answers written.
    """
    spark = session(vectors)
    schema = "query_id long, rank int, vec_id long, score double"
    # written, so that a row's number never changes again
    numbered = valid(vectors).select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding")
    rows = cut(numbered.mapInPandas(_with_unit, "row long, vec_id long, embedding array<double>, unit array<double>"), "vectors")
    # k and the query's own: no answer needs more rows of one direction
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("unit").orderBy("vec_id", "row"))).where(F.col("r") <= k + 1)
    members = F.collect_list(F.struct("vec_id", "row", "embedding"))
    entries = cut(few.groupBy("unit").agg(members.alias("members")).select(F.monotonically_increasing_id().alias("c"), "unit", "members"), "entries")
    n = entries.count()
    asked = rows.where(F.col("vec_id") % every == 0)
    blocks = buckets_for(asked.count(), QUERY_BLOCK)
    if not n:
        return spark.createDataFrame([], schema)
    sample = hashed_sample(entries.select("c", "unit", F.xxhash64("unit").alias("h")), "h", n, fit_rows).toPandas().sort_values(["h", "c"])
    books = spark.sparkContext.broadcast(train(_unit(sample["unit"])))
    parts = buckets_for(n, SCAN_ROWS)
    index = cut(entries.select("c", "unit").mapInPandas(_encoder(books), "c long, codes binary, norm float, off double, unit binary").repartition(parts, "c"), "index")
    found = []
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).orderBy("vec_id", "row").toPandas()
        if not len(block):
            continue
        queries = spark.sparkContext.broadcast((block["vec_id"].to_numpy(np.int64), _unit(block["embedding"]).astype(np.float32), _scaled(block["embedding"]), block["row"].to_numpy(np.int64), _unit(block["unit"])))
        near = index.mapInPandas(_scanner(books, queries, rerank, k), "q long, c long, s double")
        every = Window.partitionBy("q").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        best = near.withColumn("edge", F.nth_value("s", k + 1).over(every)).where(F.col("edge").isNull() | (F.col("s") >= F.col("edge") - SAME)).select("q", "c")
        each = best.join(entries, "c").select("q", F.explode("members").alias("m")).select("q", "m.*")
        scored = each.mapInPandas(_reranker(queries), "q long, query_id long, vec_id long, row long, score double")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.round("score", DIGITS).desc(), "vec_id", "row"))
        found.append(cut(scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "neighbours"))
        queries.destroy()
    for table in (rows, entries, index):
        drop_cut(table)
    out = found[0] if found else spark.createDataFrame([], schema)
    for f in found[1:]:
        out = out.union(f)
    return out


def op4_quantisation(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
