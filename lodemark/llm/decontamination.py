"""Benchmark decontamination: BM25 with block-max WAND over test items, then overlap of question and answer.

Test items are few against the training texts, so they are the index and every training passage is a query. Scores are
shares of an item's own score, which makes one threshold fit items of any length. A passage whose terms' upper bounds don't
add up to the threshold can't reach it with any item: that first pivot test of WAND runs on arrays, for all passages of a
text at once, and the rest runs posting by posting with block maxima. All items above the threshold are kept and verified.

Document frequencies and the mean length are those of all items. An index holds a bounded part of them; more items are more
passes over the texts, one index at a time. Items of about one length share their passages' width.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemark.llm.common import buckets_for, cut, drop_cut, session, small_batches

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage has to reach before it is verified. Words that are left out may weigh more
#: than others, so this lies well below the overlap asked.
THRESHOLD = 0.5
SHINGLE, OVERLAP = 5, 0.8
#: Blocks of an index.
BLOCKS = 64
#: Items and words of items that one index is built from, about: it is broadcast.
SHARD_ITEMS, SHARD_WORDS = 20_000, 400_000
#: Items share passages with items up to so many times as long.
LENGTHS = 4
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]*")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of all sentences but the last that has words, and of the last; one sentence is both."""
    parts = [w for s in SENTENCE.findall(text) if (w := words_of(s))]
    if len(parts) < 2:
        return (parts or [[]])[0], (parts or [[]])[0]
    return [w for p in parts[:-1] for w in p], parts[-1]


def shingles(words: list[str], n: int = SHINGLE) -> set[str]:
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


class Terms(dict):
    """Numbers of terms; -1 for a word that no item has."""

    def __missing__(self, word: str) -> int:
        return -1


@dataclass
class Statistics:
    """Of all items: how many, their mean number of words, and how many of them have each term."""

    n: int
    mean: float
    seen: dict[str, int]

    @classmethod
    def of(cls, texts: list[str]) -> Statistics:
        words = [w for t in texts if (w := words_of(t))]
        return cls(len(words), sum(map(len, words)) / max(1, len(words)), Counter(t for w in words for t in set(w)))

    def weights(self, words: list[str]) -> dict[str, float]:
        """BM25 weight of each term of an item."""
        flat = K1 * (1 - B + B * len(words) / self.mean)
        return {t: math.log(1 + (self.n - self.seen[t] + 0.5) / (self.seen[t] + 0.5)) * f * (K1 + 1) / (f + flat) for t, f in Counter(words).items()}


class Part:
    """Postings of items of about one length, by term; impacts are shares of the item's own score.

    Blocks are ranges of items, the same for all terms, and maxima[t, b] is the largest impact of term t in block b.
    """

    def __init__(self, items: list[tuple[int, str, list[str]]], longest: int, terms: Terms, statistics: Statistics):
        self.item_ids, self.longest = [i for i, _, _ in items], longest
        lists: dict[int, list[tuple[int, float]]] = {}
        for i, (_, _, words) in enumerate(items):
            weight = statistics.weights(words)
            own = sum(weight.values())
            for t, x in weight.items():
                lists.setdefault(terms[t], []).append((i, x / own))
        self.local = np.full(len(terms) + 1, -1, np.int64)
        self.local[list(lists)] = np.arange(len(lists))
        self.postings, self.impacts = [[i for i, _ in p] for p in lists.values()], [[x for _, x in p] for p in lists.values()]
        self.block = max(1, -(-len(items) // BLOCKS))
        self.maxima = np.zeros((len(lists), -(-len(items) // self.block)), np.float32)
        for t, (p, x) in enumerate(zip(self.postings, self.impacts)):
            np.maximum.at(self.maxima[t], np.array(p) // self.block, np.nextafter(np.array(x, np.float32), np.float32(2)))
        self.bounds = self.maxima.max(axis=1, initial=0).astype(float)
        self.wanted = []
        for _, text, _ in items:
            q, a = question_answer(text)
            self.wanted.append((shingles(q), set(a), min(SHINGLE, len(q))))

    def wand(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All items whose impacts over the terms (local numbers, distinct) add up to the threshold or more.

        Blocks whose maxima can't reach it are left out whole. In the others the pivot is the first item at which the
        maxima of the lists before it add up to the threshold; lists before the pivot seek it, and it is scored if they
        are all there.
        """
        found, upper, enough = [], self.maxima[terms], threshold - 1e-6
        for b in np.nonzero(upper.sum(axis=0, dtype=np.float64) >= enough)[0].tolist():
            lists = []
            for t, most in zip(terms.tolist(), upper[:, b].tolist()):
                if most:
                    p = self.postings[t]
                    head = bisect_left(p, b * self.block)
                    lists.append([p[head], head, bisect_left(p, (b + 1) * self.block, head), most, t])
            while lists:
                lists.sort()
                total, pivot = 0.0, None
                for item, _, _, most, _ in lists:
                    total += most
                    if total >= enough:
                        pivot = item
                        break
                if pivot is None:
                    break
                if lists[0][0] == pivot:
                    score = sum(self.impacts[t][head] for item, head, _, _, t in lists if item == pivot)
                    if score >= threshold - 1e-9:
                        found.append((pivot, score))
                    pivot += 1
                for x in lists:
                    if x[0] >= pivot:
                        break
                    p = self.postings[x[4]]
                    x[1] = bisect_left(p, pivot, x[1], x[2])
                    x[0] = p[x[1]] if x[1] < x[2] else None
                lists = [x for x in lists if x[0] is not None]
        return found

    def matches(self, words: list[str], ids: np.ndarray, threshold: float, overlap: float) -> list[tuple[int, float, float, float, int]]:
        """(item, score, question overlap, answer overlap, first word of the passage) of each item's best verified passage."""
        ids = self.local[ids]
        step, width = self.longest, 2 * self.longest + 16
        bound = np.concatenate(([0.0], np.cumsum(np.where(ids >= 0, self.bounds[ids], 0))))
        starts = np.arange(0, max(1, len(words) - self.longest - 15), step)
        stops = np.minimum(starts + width, len(words))
        best: dict[int, tuple] = {}
        for s in starts[bound[stops] - bound[starts] >= threshold - 1e-9].tolist():
            here = np.unique(ids[s : s + width])
            here = here[here >= 0]
            if self.bounds[here].sum() < threshold - 1e-6:
                continue
            passage = None
            for item, score in self.wand(here, threshold):
                if passage is None:
                    passage = words[s : s + width]
                    held, every = {}, set(passage)
                question, answer, n = self.wanted[item]
                if n not in held:
                    held[n] = shingles(passage, n)
                q, a = len(question & held[n]) / len(question), len(answer & every) / len(answer)
                if q >= overlap and a >= overlap and (item not in best or score > best[item][0] + 1e-12):
                    best[item] = (score, q, a, s)
        return [(self.item_ids[i], *found) for i, found in best.items()]


@dataclass
class Index:
    """Items by length, each length with postings of its own; all share the numbers of terms."""

    terms: Terms
    parts: list[Part]

    @classmethod
    def build(cls, items: list[tuple[int, str]], statistics: Statistics | None = None) -> Index:
        """An index of the items that have words; statistics are those of these items, unless given."""
        statistics = statistics or Statistics.of([t for _, t in items])
        split = sorted((i, t, w) for i, t in items if (w := words_of(t)))
        terms = Terms((t, k) for k, t in enumerate(dict.fromkeys(t for _, _, w in split for t in w)))
        lengths: dict[int, list] = {}
        for x in split:
            lengths.setdefault(math.ceil(math.log(len(x[2]), LENGTHS) - 1e-9), []).append(x)
        return cls(terms, [Part(x, LENGTHS**k, terms, statistics) for k, x in sorted(lengths.items())])

    def matches(self, text: str | None, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[int, float, float, float, int]]:
        """(item id, score, question overlap, answer overlap, first word of the passage) of the items found, by id."""
        words = words_of(text)
        if not words or not self.parts:
            return []
        ids = np.fromiter(map(self.terms.__getitem__, words), np.int64, len(words))
        return sorted(m for p in self.parts for m in p.matches(words, ids, threshold, overlap))


def build_indexes(benchmark: DataFrame, shard_items: int = SHARD_ITEMS, shard_words: int = SHARD_WORDS, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """Indexes over all items that have words, one after another; each is built from about as many as the bounds say.

    Items without words and items without an id can't be matched and are left out. Statistics are those of all items:
    they are counted where the items are, and an index fetches the counts of its own terms.
    """
    spark = session(benchmark)
    small_batches(spark)
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").distinct()

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(words_of)

    items = cut(items.withColumn("w", split("t")).where("size(w) > 0"), "items")
    size = items.agg(F.count("*").alias("n"), F.sum(F.size("w")).alias("words")).first()
    shards = max(buckets_for(size["n"], shard_items), buckets_for(size["words"] or 0, shard_words)) if size["n"] else 0
    rows = items.withColumn("s", F.pmod(F.xxhash64("i"), F.lit(shards or 1)).cast("int"))
    each = rows.select("s", F.explode(F.array_distinct("w")).alias("w"))
    seen = cut(each.groupBy("w").agg(F.count("*").alias("n")), "terms")
    for k in range(shards):
        mine = rows.where(F.col("s") == k)
        counts = seen.join(each.where(F.col("s") == k).select("w").distinct(), "w", "left_semi").collect()
        yield Index.build([(r["i"], r["t"]) for r in mine.select("i", "t").collect()], Statistics(size["n"], size["words"] / size["n"], {r["w"]: r["n"] for r in counts}))
    drop_cut(items)
    drop_cut(seen)


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, start_word long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_items: int = SHARD_ITEMS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, score, question_overlap, answer_overlap, start_word.

    Found: a passage of the document (a little over twice as long as items of about that length can be, and that length apart)
    reaches the threshold and holds `overlap` of the question's five-word shingles and of the answer's words; the best
    passage is reported, the earliest of equals. Null and empty texts hold nothing, texts of any length are searched
    whole; rows with null or repeated ids are searched like any other, an item id with two texts is two items. Without
    items or documents there are no rows. Extra columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))

    def searcher(index):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                found = [(None if pd.isna(doc) else int(doc), item, round(score, 9), q, a, s) for doc, text in zip(pdf["doc_id"], pdf["text"]) for item, score, q, a, s in index.value.matches(text, threshold, overlap)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "start_word"]).astype({"doc_id": "Int64"})

        return run

    return _each_index(benchmark, shard_items, shard_words, rows.sparkSession.createDataFrame([], SCHEMA), lambda index, _: rows.mapInPandas(searcher(index), SCHEMA), True)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_items: int = SHARD_ITEMS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs without the rows that hold a benchmark item; all others as they are.

    Null and empty texts stay, texts of any length are searched whole; null and repeated ids, ties and extra columns of
    any name make no difference. Without items all rows stay.
    """

    def clean(index):
        @F.pandas_udf("boolean")
        def none(texts: pd.Series) -> pd.Series:
            return pd.Series([not index.value.matches(t, threshold, overlap) for t in texts], dtype=bool)

        return none(F.col("text"))

    return _each_index(benchmark, shard_items, shard_words, docs, lambda index, left: left.where(clean(index)), False)


def _each_index(benchmark: DataFrame, shard_items: int, shard_words: int, begin: DataFrame, step, add: bool) -> DataFrame:
    """What the steps of all indexes give: added up, or each from what the one before left.

    A broadcast index is one of many only if it has been used up: with several, each step is a written table, and the
    index is dropped before the next one is built.
    """
    context, out, last = session(begin).sparkContext, begin, None
    for index in build_indexes(benchmark, shard_items, shard_words):
        if last is not None:
            found = cut(step(last, out), "leaks")
            last.destroy()
            out = out.union(found) if add else found
        last = context.broadcast(index)
    if last is None:
        return out
    found = step(last, out)
    return out.union(found) if add and out is not begin else found


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
