"""Quality classifier from weak labels: heuristic labellers, their accuracies by expectation-maximisation, a hashed scorer.

Each labeller votes good, bad or nothing on a text. Votes of all documents are counted by pattern (at most 3^labellers
rows, whatever the input), and a two-class model in which labellers err independently is fitted to all counts: it gives
each labeller's accuracy and each pattern's posterior. Posteriors then label a linear scorer over hashed features, which
sees more than the labellers do and has no gaps where they all abstain.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemark.llm.common import cut, free, hashed_sample, small_batches

BINS = 4096
#: About so many rows fit the linear scorer: those with the smallest hashes of id and text.
FIT_ROWS = 20_000
GOOD, BAD = 1, 2
SYMBOLS = re.compile(r"[%$&*#|<>{}\[\]@^~\\=+_]")
#: Characters that a word's shape is remembered for; longer words are read whole each time.
REMEMBERED = 64


def _vote(x: float, good: float, bad: float) -> int:
    """Bad from `bad` on, good up to `good`, nothing between."""
    return BAD if x >= bad else GOOD if x <= good else 0


def votes(text: str, words: list[str]) -> list[int]:
    """What each labeller says of a text: 0 nothing, 1 good, 2 bad."""
    n = len(words)
    if not n:
        return [0, 0, 0, BAD, 0, 0, 0]
    # whether there are two letters; the count ends at the second
    letters = len(list(islice(filter(str.isalpha, text), 2)))
    repeats = sum(a == b for a, b in zip(words, words[1:])) / n
    upper = sum(w.isupper() and len(w) > 1 for w in words) / n
    symbols = len(SYMBOLS.findall(text)) / len(text)
    ends = sum(w[-1] in ".!?" for w in words) / n
    lines = text.split("\n")
    return [
        _vote(repeats, 0.02, 0.2),
        _vote(upper, 0.1, 0.4),
        _vote(symbols, 0.002, 0.015),
        BAD if letters < 2 else _vote(ends, 0.35, 0.6) if ends else 0,
        _vote(1 - len(set(words)) / n, 0.75, 0.9) if n >= 40 else 0,
        _vote(sum(map(len, words)) / n, 12, 25),
        _vote(1 - len(set(lines)) / len(lines), 0.2, 0.6) if len(lines) > 2 else 0,
    ]


LABELLERS = 7


def shape(word: str) -> int:
    """Bin of a word's shape: runs of capitals, small letters and digits as one mark each, other characters as they are."""
    return _known_shape(word) if len(word) <= REMEMBERED else _shape(word)


def _shape(word: str) -> int:
    out: list[str] = []
    for c in word:
        m = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != m:
            out.append(m)
    return zlib.crc32("".join(out).encode("utf-8", "replace")) % (BINS - 2)


_known_shape = lru_cache(maxsize=200_000)(_shape)


def features(words: list[str]) -> tuple[list[int], list[float]]:
    """Shares of words by shape bin, of words equal to the one before, and of words seen earlier in the text."""
    if not words:
        return [], []
    n = len(words)
    bins, counts = np.unique(np.fromiter(map(shape, words), np.int64, n), return_counts=True)
    again = sum(a == b for a, b in zip(words, words[1:]))
    # as many again as a text of its length has in the mean don't count: vocabularies grow about as the power 0.8
    seen = max(0.0, 1 - len(set(words)) / n**0.85)
    return [*bins.tolist(), BINS - 2, BINS - 1], [*(counts / n).tolist(), again / n, seen]


def mark(text: str | None) -> tuple[int, list[int], list[float]]:
    """A text's votes as one number in base 3, and its features."""
    words = (text or "").split()
    pattern = 0
    for v in votes(text or "", words):
        pattern = pattern * 3 + v
    return pattern, *features(words)


def _marks(text: str) -> Column:
    @F.pandas_udf("struct<pattern: int, bins: array<int>, shares: array<double>>")
    def marked(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([mark(t) for t in texts], columns=["pattern", "bins", "shares"])

    return marked(F.col(text))


def expectation_maximisation(counts: dict[int, int], rounds: int = 200) -> tuple[float, np.ndarray, dict[int, float]]:
    """The share of good texts, P(vote | class) of each labeller, and the posterior of good for each pattern."""
    patterns = sorted(counts)
    v = np.array([[p // 3**k % 3 for k in range(LABELLERS - 1, -1, -1)] for p in patterns], np.int64).reshape(-1, LABELLERS)
    n = np.array([counts[p] for p in patterns], float)
    # to begin with, a vote for bad is believed over votes for good: labellers see only their own fault
    good = np.where((v == BAD).any(axis=1), 0.1, 0.9)
    prior, tables = 0.9, np.zeros((2, LABELLERS, 3))
    for _ in range(rounds):
        for c, w in enumerate((n * (1 - good), n * good)):
            for k in range(LABELLERS):
                tables[c, k] = np.bincount(v[:, k], w, 3) + 0.1
                tables[c, k, 1:] /= tables[c, k, 1:].sum()
                tables[c, k, 0] = 1  # what a labeller leaves out says nothing: short texts aren't a class of their own
        prior = float(np.clip((n * good).sum() / max(n.sum(), 1), 1e-3, 1 - 1e-3))
        at = [sum(np.log(tables[c, k, v[:, k]]) for k in range(LABELLERS)) for c in (0, 1)]
        odds = np.log(prior / (1 - prior)) + at[1] - at[0]
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        moved, good = np.abs(new - good).max(initial=0), new
        if moved < 1e-6:
            break
    return prior, tables, dict(zip(patterns, good.tolist()))


def fit_scorer(rows: list[tuple[list[int], list[float], float]], rounds: int = 60, seed: int = 42) -> np.ndarray:
    """Weights (the last is the constant) of a logistic scorer of posterior labels, by mini-batch Adagrad."""
    w, g2 = np.zeros(BINS + 1), np.full(BINS + 1, 1e-6)
    w[-1] = 1.0
    if not rows:
        return w
    draw = np.random.default_rng(seed)
    target = np.array([r[2] for r in rows])
    size = np.array([len(r[0]) for r in rows])
    flat_b, flat_v = np.concatenate([np.array(r[0], np.int64) for r in rows]), np.concatenate([np.array(r[1]) for r in rows])
    at = np.concatenate(([0], np.cumsum(size)))
    for _ in range(rounds):
        order = draw.permutation(len(rows))
        for k in range(0, len(order), 512):
            part = order[k : k + 512]
            take = np.concatenate([np.arange(at[i], at[i + 1]) for i in part])
            row = np.repeat(np.arange(len(part)), size[part])
            z = np.bincount(row, flat_v[take] * w[flat_b[take]], len(part)) + w[-1]
            e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[part]
            grad = np.bincount(flat_b[take], flat_v[take] * e[row], BINS + 1)
            grad[-1] = e.sum()
            grad = grad / len(part) + 1e-6 * w
            g2 += grad * grad
            w -= 0.5 * grad / np.sqrt(g2)
    return w


def score(bins, shares, w: np.ndarray) -> float:
    z = float(np.dot(w[np.asarray(bins, np.int64)], np.asarray(shares, float))) + w[-1] if len(bins) else -5.0
    return 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))


def train(marks: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, dict[int, float], np.ndarray]:
    """The scorer's weights, the posteriors by pattern, and the labellers' tables. Votes of all rows count.

    To the driver come at most 3^7 pattern counts and the features of fit_rows rows.
    """
    counts = {r["pattern"]: r["n"] for r in marks.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    _, tables, posterior = expectation_maximisation(counts)
    sample = sorted(hashed_sample(marks.select("h", "pattern", "bins", "shares"), "h", sum(counts.values()), fit_rows).collect(), key=lambda r: (r["h"], r["pattern"]))
    return fit_scorer([(r["bins"], r["shares"], posterior[r["pattern"]]) for r in sample if r["bins"]]), posterior, tables


def _scored(name: str, w: np.ndarray) -> Column:
    @F.pandas_udf("double")
    def scored(bins: pd.Series, shares: pd.Series) -> pd.Series:
        return pd.Series([round(score(b, s, w), 9) for b, s in zip(bins, shares)], dtype=float)

    return scored(F.col(f"{name}.bins"), F.col(f"{name}.shares"))


def classify(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, votes, posterior, score and keep.

    Null texts and texts without words get score 0.0067 and are not kept; texts and words of any length are read whole.
    Null and repeated ids pass through, ties have one score; an empty table gives an empty one; extra columns are not
    looked at.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("h"), _marks("text").alias("m"))
    marks = cut(rows, "marks")
    w, posterior, _ = train(marks.select("h", "m.*"))

    @F.pandas_udf("double")
    def believed(pattern: pd.Series) -> pd.Series:
        return pattern.map(posterior).astype(float)

    out = marks.select("doc_id", F.lpad(F.conv(F.col("m.pattern").cast("string"), 10, 3), LABELLERS, "0").alias("votes"), believed("m.pattern").alias("posterior"), _scored("m", w).alias("score"))
    return out.withColumn("keep", F.col("score") >= threshold)


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that the scorer, trained on these docs, rejects; all others as they are.

    Null texts and texts without words go. Null and repeated ids, ties and extra columns of any name make no difference;
    an empty table stays empty. Texts are read in Python once: docs and marks are one written table until they are scored.
    """
    small_batches(docs.sparkSession)
    m, h = free(docs.columns, "m", "h")
    marks = cut(docs.withColumns({h: F.xxhash64("doc_id", "text"), m: _marks("text")}), "marks")
    w, _, _ = train(marks.select(F.col(h).alias("h"), f"{m}.*"))
    return marks.where(_scored(m, w) >= threshold).select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
