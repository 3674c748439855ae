"""Toxicity by compression distance: two zstandard dictionaries, and how much better one compresses a window than the other.

A window is a word between two marks that both dictionaries end with, so its compressed length is a constant plus what the
word itself costs. The ordinary dictionary is trained on ordinary texts, the toxic one on the windows of toxic texts that
hold a five-character run far commoner there; windows of ordinary texts that the toxic one still compresses better are
added to the ordinary one. Window lengths are calibrated: for each pair of a window's size and its gain, the log ratio of
how often it is met in toxic training windows and in ordinary texts. A logistic of a text's highest ratios is its score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemark.llm.common import small_batches
from lodemark.llm.folds import held_out

#: Labelled rows that are learned from at most, by class: those with the smallest hash of the id.
TOXIC_ROWS, ORDINARY_ROWS = 3000, 6000
TOXIC_BYTES, ORDINARY_BYTES, HARD_BYTES = 4096, 65_536, 32_768
GRAM, LEAST_TEXTS, TIMES = 5, 6, 8
LEVEL = 3
HEAD, TAIL = b"<|=0123456789abcdefghij~=|>", b"#+KLMNOPQRSTUVWXYZ+#"
CACHE = 400_000
SIZES, GAINS = 24, 16
WORD = re.compile(r"[^\W\d_]+")


def windows_of(text: str | None) -> list[str]:
    """The distinct words of a text, lower case."""
    return list(dict.fromkeys(WORD.findall((text or "").lower())))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_checksum=0, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content + TAIL + HEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A dictionary of at most size bytes; of too few samples, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Gains:
    """Bytes that the toxic dictionary saves on a window against the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic, self.known = _compressor(ordinary), _compressor(toxic), {}

    def __call__(self, word: str) -> int:
        if (found := self.known.get(word)) is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            window = HEAD + b" " + word.encode("utf-8", "replace") + b" " + TAIL
            found = self.known[word] = len(self.ordinary.compress(window)) - len(self.toxic.compress(window))
        return found


def _grams(words: list[str]) -> set[str]:
    return {w[i : i + GRAM] for w in (f" {x} " for x in words) for i in range(max(1, len(w) - GRAM + 1))}


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    ratios: np.ndarray
    weights: np.ndarray

    def scorer(self):
        """text -> score, with a cache of its own."""
        gains = Gains(self.ordinary, self.toxic)

        def score(text: str | None) -> float:
            z = float(self.features(windows_of(text), gains) @ self.weights)
            return 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))

        return score

    def features(self, words: list[str], gains: Gains) -> np.ndarray:
        """The two highest ratios of a text's windows, how many are above zero, how many windows there are, and 1."""
        found = [(g, w) for w in words if (g := gains(w)) > 0]
        rows = sorted((float(self.ratios[min(len(w.encode("utf-8", "replace")), SIZES - 1), min(g, GAINS - 1)]) for g, w in found), reverse=True)
        top = [*(max(x, 0.0) for x in rows[:2]), 0.0, 0.0]
        return np.array([top[0], top[1], np.log1p(sum(x > 1 for x in rows)), np.log1p(len(words)) / 4, 1.0])


def train(toxic: list[str], ordinary: list[str]) -> Model:
    """A model of labelled texts; without texts of both classes every score is that of the commoner."""
    if not toxic or not ordinary:
        return Model(b"", b"", np.zeros((SIZES, GAINS)), np.array([0, 0, 0, 0, -3.0 if not toxic else 3.0]))
    bad, good = [windows_of(t) for t in dict.fromkeys(toxic)], [windows_of(t) for t in dict.fromkeys(ordinary)]
    # one half of the texts trains the dictionaries, the other calibrates what they say of texts not seen
    bad_fit, bad_rest, good_fit, good_rest = bad[::2], bad[1::2] or bad, good[::2], good[1::2] or good
    many, few = Counter(), Counter()
    for x in bad_fit:
        many.update(_grams(x))
    for x in good_fit:
        few.update(_grams(x))
    least = min(LEAST_TEXTS, max(1, len(bad_fit) // 50))
    marks = {g for g, n in many.items() if n >= least and n / len(bad_fit) >= TIMES * (few[g] + 1) / len(good_fit)}
    witness = [w for x in bad_fit for w in x if any(f" {w} "[i : i + GRAM] in marks for i in range(len(w) + 3 - GRAM))] or [w for x in bad_fit for w in x]
    toxic_dict = _trained(TOXIC_BYTES, [f" {w} ".encode() for w in witness])
    plain = _trained(ORDINARY_BYTES, [" ".join(x).encode() for x in good_fit])
    first, hard = Gains(plain, toxic_dict), Counter()
    for x in good_fit:
        hard.update(w for w in x if first(w) > 2)
    extra, held = [], 0
    for w, n in hard.most_common():
        if n > 1 and held + len(w) < HARD_BYTES:
            extra.append(f" {w} ".encode())
            held += len(extra[-1])
    model = Model(b"".join(extra[::-1]) + plain, toxic_dict, np.zeros((SIZES, GAINS)), np.zeros(5))
    gains = Gains(model.ordinary, model.toxic)
    counts = np.full((2, SIZES, GAINS), 0.02)
    for c, texts in enumerate((good_rest, bad_rest)):
        for x in texts:
            for w in x:
                if (g := gains(w)) > 0:
                    counts[c, min(len(w.encode("utf-8", "replace")), SIZES - 1), min(g, GAINS - 1)] += 1
    rates = counts / np.array([len(good_rest), len(bad_rest)])[:, None, None]
    # what toxic texts have beyond the windows that any text has
    model.ratios = np.log(np.maximum(rates[1] - rates[0], 1e-5) / rates[0])
    rows = [(model.features(x, gains), y) for y, texts in ((1.0, bad_rest), (0.0, good_rest)) for x in texts]
    a, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    w = np.zeros(5)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(5)
        w += np.linalg.solve(h, a.T @ (y - p) - 1e-3 * w)
    model.weights = w
    return model


def learn(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> Model:
    """A model of the labelled documents that aren't held out; at most so many texts of each class come to the driver."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = []
    for wanted, most in (("toxic > 0", toxic_rows), ("toxic <= 0", ordinary_rows)):
        # ids are drawn without their texts; at most `most` of them are broadcast to fetch those
        ids = known.where(wanted).select("doc_id").orderBy(F.xxhash64("doc_id")).limit(most)
        found = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids), "doc_id")
        texts.append([r["text"] for r in found.groupBy("doc_id").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id")).select("text").collect()])
    return train(*texts)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on).

    Null texts, empty ones and those without letters have no window and get the score of a text that nothing speaks
    against. Null and repeated ids pass through; an empty table gives an empty one; extra columns are not looked at.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = model.scorer()
        for pdf in batches:
            s = pd.Series([score(t) for t in pdf["text"]], dtype=float, index=pdf.index)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": s, "predicted": (s >= 0.5).astype("int32")})

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_toxicity(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
