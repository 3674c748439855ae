"""Language of whole texts through a linear-chain conditional random field over their words.

A word's features are its affixes, its letter trigrams and, as a lexicon, the word itself, those known from training. The
field's states are the languages; learned transitions say how seldom a text switches. Forward-backward gives each word's
distribution over the languages in its context, in texts that switch between several too; a text's language is the one
with most words. The recursions run as a blocked scan: all texts of a batch are one chain with restarts, whose blocks are
multiplied up side by side, so a long text costs what as many words in short ones do.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodemark.llm.common import small_batches
from lodemark.llm.folds import held_out

#: Rows of each language that are learned from at most, those with the smallest hash of the id, and features kept at most.
FIT_ROWS, FEATURES = 150, 60_000
ROUNDS = 25
CACHE = 200_000
STEP = 128
UNKNOWN = "und"
#: Letters of a piece of a word: runs without white space, as Chinese and Thai have them, are read piece by piece.
PIECE = 40


def _class(chars: set[str]) -> str:
    """The inside of a character class of these characters."""
    out, begin = [], None
    for c in ALL:
        if c in chars:
            begin = c if begin is None else begin
            last = c
        elif begin is not None:
            out.append(f"\\U{ord(begin):08x}-\\U{ord(last):08x}")
            begin = None
    return "".join(out)


# between these planes no character is assigned
ALL = [chr(c) for c in chain(range(0x34000), range(0xE0000, 0xE0200))]
#: Word characters that are neither letters nor decimal digits, such as fractions, and marks that combine with letters.
RARE_NUMERALS, RARE_MARKS = {c for c in ALL if c.isalnum() and not c.isalpha() and not c.isdecimal()}, {c for c in ALL if unicodedata.category(c)[0] == "M"}
RARE, NUMERALS, MARKS = frozenset(RARE_NUMERALS | RARE_MARKS), _class(RARE_NUMERALS), _class(RARE_MARKS)
#: A letter and what follows of letters and marks; in texts without rare characters a shorter pattern finds the same.
WORD = re.compile(rf"[^\W\d_{NUMERALS}](?:[^\W\d_{NUMERALS}]|[{MARKS}]){{0,{PIECE - 1}}}")
PLAIN = re.compile(rf"[^\W\d_]{{1,{PIECE}}}")


def pattern_for(text: str) -> re.Pattern:
    # a set tells it much faster than a character class of so many ranges
    return PLAIN if text.isascii() or RARE.isdisjoint(text) else WORD


def words_of(text: str | None) -> list[str]:
    """The words of a text, lower case; a longer one in pieces of PIECE characters."""
    text = (text or "").lower()
    return pattern_for(text).findall(text)


def features_of(word: str) -> list[str]:
    """Prefixes and suffixes of one to three letters, trigrams, and the word."""
    n = len(word)
    found = [f"={word}"]
    for k in range(1, min(n, 3) + 1):
        found += (f"^{word[:k]}", f"{word[-k:]}$")
    return found + [word[i : i + 3] for i in range(n - 2)]


def posteriors(emit: np.ndarray, trans: np.ndarray, begin: np.ndarray, first: np.ndarray, step: int = STEP, pairs: bool = False):
    """P(state of each word | all words): emit (n, k) and trans (k, k) are log weights, begin (k) of a text's first word.

    first marks the words that begin a text. With pairs, also the expected number of each transition inside texts.
    """
    n, k = emit.shape
    blocks = -(-n // step)
    e = np.ones((blocks * step, k))
    e[:n] = np.exp(emit - emit.max(axis=1, keepdims=True))
    start = np.zeros(blocks * step, bool)
    start[:n] = first
    start[n:] = True
    e, start = e.reshape(blocks, step, k), start.reshape(blocks, step)
    t, b = np.exp(trans), np.exp(begin - begin.max())
    product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for s in range(step):
        moved = product @ t
        here = start[:, s]
        if here.any():
            moved[here] = product[here].sum(axis=2, keepdims=True) * b
        product = moved * e[:, s, None, :]
        product /= product.sum(axis=(1, 2), keepdims=True)
    into, out = np.empty((blocks, k)), np.empty((blocks, k))
    v = np.full(k, 1 / k)
    for i in range(blocks):
        into[i] = v
        v = v @ product[i]
        v = v / v.sum()
    v = np.ones(k)
    for i in range(blocks - 1, -1, -1):
        out[i] = v
        v = product[i] @ v
        v = v / v.sum()
    alpha = np.empty((step, blocks, k))
    v = into
    for s in range(step):
        v = np.where(start[:, s, None], b, v @ t) * e[:, s]
        v = v / v.sum(axis=1, keepdims=True)
        alpha[s] = v
    beta = np.empty((step, blocks, k))
    v = out
    for s in range(step - 1, -1, -1):
        beta[s] = v
        w = e[:, s] * v
        v = np.where(start[:, s, None], (w * b).sum(axis=1, keepdims=True), w @ t.T)
        v = v / v.sum(axis=1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    flat = gamma.transpose(1, 0, 2).reshape(-1, k)[:n]
    if not pairs:
        return flat
    before, after = alpha.transpose(1, 0, 2).reshape(-1, k)[: n - 1], (e * beta.transpose(1, 0, 2)).reshape(-1, k)[1:n]
    inside = ~first[1:n]
    joint = before[inside][:, :, None] * t[None] * after[inside][:, None, :]
    return flat, (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


@dataclass
class Model:
    langs: list[str]
    index: dict[str, int]
    weights: np.ndarray
    trans: np.ndarray
    begin: np.ndarray

    def marker(self):
        """lists of words -> P(language) of every word of all of them, one after another; with a cache of word weights of its own."""
        known: dict[str, int] = {}
        table = np.zeros((0, len(self.langs)), np.float32)

        def mark(split: list[list[str]]) -> np.ndarray:
            nonlocal table
            if len(known) > CACHE:
                known.clear()
                table = table[:0]
            new = [w for w in dict.fromkeys(w for ws in split for w in ws) if w not in known]
            known.update((w, len(table) + i) for i, w in enumerate(new))
            table = np.concatenate((table, self.emission(new).astype(np.float32)))
            sizes = np.array([len(ws) for ws in split], np.int64)
            ids = np.fromiter((known[w] for ws in split for w in ws), np.int64, int(sizes.sum()))
            if not len(ids) or not self.langs:
                return np.zeros((len(ids), len(self.langs)))
            first = np.zeros(len(ids), bool)
            first[np.concatenate(([0], np.cumsum(sizes)))[:-1][sizes > 0]] = True
            return posteriors(table[ids].astype(float), self.trans, self.begin, first)

        return mark

    def predictor(self):
        """texts -> (language, score) of each."""
        mark = self.marker()

        def predict(texts: list[str | None]) -> list[tuple[str, float]]:
            split = [words_of(t) for t in texts]
            sizes = np.array([len(ws) for ws in split], np.int64)
            out = [(UNKNOWN, 0.0)] * len(texts)
            found = mark(split)
            if found.size:
                full = np.nonzero(sizes)[0]
                at = np.concatenate(([0], np.cumsum(sizes[full])))[:-1]
                share = np.add.reduceat(found, at, axis=0) / sizes[full][:, None]
                for i, s in zip(full.tolist(), share):
                    best = int(s.argmax())
                    out[i] = (self.langs[best], float(min(max(s[best], 0.0), 1.0)))
            return out

        return predict

    def labeller(self):
        """texts -> spans of each: (start, end, language, score), runs of words of one language, by character."""
        mark = self.marker()

        def label(texts: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
            places = [[m.span() for m in pattern_for(t or "").finditer(t or "")] for t in texts]
            found = mark([[t[a:b].lower() for a, b in p] for t, p in zip(texts, places)])
            out, at = [], 0
            for p in places:
                mine, at = found[at : at + len(p)], at + len(p)
                spans = []
                if mine.size:
                    best = mine.argmax(axis=1)
                    edges = [0, *(np.nonzero(np.diff(best))[0] + 1).tolist(), len(p)]
                    spans = [(p[i][0], p[j - 1][1], self.langs[best[i]], float(mine[i:j, best[i]].mean())) for i, j in zip(edges, edges[1:])]
                out.append(spans)
            return out

        return label

    def emission(self, words: list[str]) -> np.ndarray:
        """Log weights of each word: the sum over the features that training knows."""
        rows = [[self.index[f] for f in features_of(w) if f in self.index] for w in words]
        sizes = np.array([len(r) for r in rows], np.int64)
        out = np.zeros((len(words), len(self.langs)))
        if sizes.sum():
            full = np.nonzero(sizes)[0]
            at = np.concatenate(([0], np.cumsum(sizes[full])))[:-1]
            flat = np.fromiter((i for r in rows for i in r), np.int64, int(sizes.sum()))
            out[full] = np.add.reduceat(self.weights[flat], at, axis=0)
        return out


def train(rows: list[tuple[str, str]], rounds: int = ROUNDS) -> Model:
    """A field of (text, language) rows: first with a text's language on all its words, then on each line its own."""
    langs = sorted({lang for _, lang in rows})
    lines, owner = [], []
    for i, (text, _) in enumerate(rows):
        for line in text.split("\n"):
            if ws := words_of(line):
                lines.append(ws)
                owner.append(i)
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for ws in lines for w in ws))}
    counts = Counter(f for w in vocabulary for f in features_of(w))
    index = {f: k for k, (f, n) in enumerate(counts.most_common(FEATURES)) if n > 1}
    k = len(langs)
    model = Model(langs, index, np.zeros((len(index), k)), np.zeros((k, k)), np.zeros(k))
    if k < 2 or not lines:
        return model
    of_word = [[index[f] for f in features_of(w) if f in index] for w in vocabulary]
    row = np.repeat(np.arange(len(of_word)), [len(r) for r in of_word])
    col = np.fromiter((i for r in of_word for i in r), np.int64, len(row))
    ids = np.fromiter((vocabulary[w] for ws in lines for w in ws), np.int64, sum(map(len, lines)))
    line_of = np.repeat(np.arange(len(lines)), [len(ws) for ws in lines])
    owner_of = np.array(owner)[line_of]
    first = np.concatenate(([True], owner_of[1:] != owner_of[:-1]))
    label = np.array([langs.index(rows[i][1]) for i in owner])[line_of]
    squares = [np.full_like(p, 1e-3) for p in (model.weights, model.trans, model.begin)]
    for turn in range(2):
        target = np.eye(k)[label]
        steps = np.zeros((k, k))
        np.add.at(steps, (label[:-1][~first[1:]], label[1:][~first[1:]]), 1)
        for _ in range(rounds):
            emit = np.stack([np.bincount(row, model.weights[col, c], len(of_word)) for c in range(k)], axis=1)
            gamma, joint = posteriors(emit[ids], model.trans, model.begin, first, pairs=True)
            wrong = np.stack([np.bincount(ids, (gamma - target)[:, c], len(of_word)) for c in range(k)], axis=1)
            grads = (np.stack([np.bincount(col, wrong[row, c], len(index)) for c in range(k)], axis=1) + 0.1 * model.weights, joint - steps + 0.1 * model.trans, (gamma - target)[first].sum(axis=0) + 0.1 * model.begin)
            for p, g, q in zip((model.weights, model.trans, model.begin), grads, squares):
                q += g * g
                p -= 0.3 * g / np.sqrt(q)
        if turn == 0:
            # a line in another language than its text's is told by its words alone
            emit = np.stack([np.bincount(row, model.weights[col, c], len(of_word)) for c in range(k)], axis=1)
            sums = np.stack([np.bincount(line_of, emit[ids, c], len(lines)) for c in range(k)], axis=1)
            label = sums.argmax(axis=1)[line_of]
    return model


def learn(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A field of documents that aren't held out; to the driver come at most fit_rows whole texts of each language."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", F.xxhash64("doc_id").alias("h"))
    # drawn without their texts; fit_rows of each language at most are broadcast to fetch those
    ids = rows.select("lang", "h").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= fit_rows).select("lang", "h").distinct()
    chosen = rows.join(F.broadcast(ids), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    return train([(r["text"], r["lang"]) for r in chosen.orderBy("lang", "h").collect()])


def predict_language(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score (the share of words in that language).

    Texts that are null or have no letters (numerals such as fractions are none) get `und` and score 0; texts and words
    of any length are read whole. Of languages with equal shares the first by name wins. Null and repeated ids pass
    through; an empty table gives an empty one, a model of no texts `und`; extra columns are not looked at.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = model.predictor()
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                found = predict(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def label_spans(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id and spans, the runs of words of one language in each text, in order.

    A span has start and end (characters of the text; the end is the first after it), lang, and score, the mean of its
    words' probabilities. Texts that are null or have no letters have no spans. Null and repeated ids pass through.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        label = model.labeller()
        for pdf in batches:
            found = label([None if pd.isna(t) else t for t in pdf["text"]])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "spans": pd.Series([[dict(zip(("start", "end", "lang", "score"), s)) for s in x] for x in found], index=pdf.index, dtype=object)})

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, spans array<struct<start: int, end: int, lang: string, score: double>>")


def op10_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict_language(docs, learn(docs))
