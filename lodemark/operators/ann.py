"""Approximate search: an inverted file of k-means cells, whose nearest cells are searched exactly."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemark.operators.retrieval import BLOCK_BYTES, PAIRS, TILE, Best, _pairs, _unit, met

#: Vectors that are set against all centres at once.
ROUTED = 256
#: Vectors that the cells are fitted on at least and for each cell, vectors of a cell that one task holds, and cells at most.
FIT_ROWS, FIT_PER_CELL, CELL_ROWS, CELLS = 20_000, 8, 20_000, 16_384


def cells_for(n: int) -> int:
    """Four times the root of the rows, so that cells and their rows grow alike; CELLS at most, as centres are sent to all tasks."""
    return max(1, min(CELLS, math.ceil(4 * n**0.5)))


def probes_for(cells: int) -> int:
    """A number that grows as the root of the cells, so a query's share of the rows falls as they grow (0.4 of 2000, 0.04 of 16,384 cells)."""
    return min(cells, math.ceil(5.4 * cells**0.5))


def build(kb: DataFrame, cells: int | None = None, rounds: int = 10, seed: int = 42) -> tuple[np.ndarray, DataFrame]:
    """Centres of the cells, and the knowledge base (kb_ordinal, embedding) with cell and part, a slice of a large cell."""
    n = kb.count()
    cells = cells or cells_for(n)
    sample = kb.select("kb_ordinal", "embedding").orderBy(F.xxhash64("kb_ordinal")).limit(max(FIT_ROWS, FIT_PER_CELL * cells)).toPandas()
    x, draw = _unit(sample["embedding"]), np.random.default_rng(seed)
    centre = x[draw.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        near = _cell_of(x, centre)
        sums = np.stack([np.bincount(near, x[:, d], len(centre)) for d in range(x.shape[1])], axis=1)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centre = np.where(length > 0, sums / np.where(length > 0, length, 1), centre)

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=_cell_of(_unit(pdf["embedding"]), centre).astype("int32"))

    placed = kb.select("kb_ordinal", "embedding").mapInPandas(assign, "kb_ordinal long, embedding array<float>, cell int")
    # a row for each cell: broadcast whatever the input
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("n"))
    return centre, placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("kb_ordinal"), F.col("n")).cast("int")).select("kb_ordinal", "embedding", "cell", "part")


def centres_table(spark: SparkSession, centre: np.ndarray) -> DataFrame:
    """Centres as rows (cell, centre), to be stored beside the placed vectors."""
    return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centre)], "cell int, centre array<double>")


def read_centres(rows: DataFrame) -> np.ndarray:
    return np.array([r["centre"] for r in rows.orderBy("cell").collect()])


def search(centre: np.ndarray, placed: DataFrame, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """query_id, rank, kb_ordinal, similarity: the k best of the `probes` cells nearest to each query.

    Whole cells (or parts of large ones) are dealt over blocks, and each block of queries meets each of them in a task of
    its own, as in the exact search: a query's vector is sent once to a block, not once to a cell. The task finds the
    cells of its queries and multiplies those alone.
    """
    probes = min(probes or probes_for(len(centre)), len(centre))
    group = (F.col("part") * len(centre) + F.col("cell")).cast("int")
    return met(queries.select("query_id", "embedding"), placed.withColumn("_g", group), placed.count(), centre.shape[1], k, BLOCK_BYTES, _probed(centre, probes, k), F.col("_g"))


def _cell_of(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The nearest cell of each vector, ROUTED of them at a time: all products at once would be rows times cells."""
    return np.concatenate([(x[at : at + ROUTED] @ centre.T).argmax(axis=1) for at in range(0, len(x), ROUTED)])


def _probed(centre: np.ndarray, probes: int, k: int):
    def hits(left: np.ndarray, right: np.ndarray, ids: np.ndarray, g: np.ndarray, known: dict):
        if not known:
            order = np.argsort(g % len(centre), kind="stable")
            cells, first = np.unique(g[order] % len(centre), return_index=True)
            known |= {"right": right[order], "ids": ids[order], "cells": [*zip(cells.tolist(), first.tolist(), [*first[1:].tolist(), len(g)])]}
        for at in range(0, len(left), ROUTED):
            part = left[at : at + ROUTED]
            near = np.argpartition(-(part @ centre.T), probes - 1, axis=1)[:, :probes]
            asks = np.zeros((len(centre), len(part)), bool)
            asks[near.T, np.arange(len(part))] = True
            best, wait = Best(len(part), k), []
            for cell, start, end in known["cells"]:
                q = np.nonzero(asks[cell])[0]
                for a in range(start, end, TILE) if len(q) else ():
                    s = part[q] @ known["right"][a : min(a + TILE, end)].T
                    least = best.edge[q]
                    if s.shape[1] > k:
                        least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
                    i, j = np.nonzero(s >= least[:, None] - 1e-12)
                    wait.append((q[i], a + j))
                    if sum(len(x) for x, _ in wait) > PAIRS:
                        best.add(*_scored(part, known, wait))
                        wait = []
            if wait:
                best.add(*_scored(part, known, wait))
            yield best.row + at, best.id, best.score

    return hits


def _scored(part: np.ndarray, known: dict, wait: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, j = (np.concatenate(x) for x in zip(*wait))
    return i, known["ids"][j], _pairs(part, known["right"], i, j)
