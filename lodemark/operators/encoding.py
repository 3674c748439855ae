"""Vectors from an encoder that the caller brings: a function of a batch, run where the rows are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def encode(rows: DataFrame, key: str, column: str, load: Callable[[], Callable[[list], np.ndarray]], dimensions: int, batch: int = 128) -> DataFrame:
    """key and embedding (unit vectors of floats) of each row.

    load is called once in each task and gives the encoder: a list of values of the column (captions, or images as dicts of
    height, width, nChannels and data) to a matrix of as many rows and `dimensions` columns. A matrix of another shape, and
    a vector that is zero or not finite, is an error.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load()
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                found = np.asarray(encoder(part[column].tolist()), np.float64)
                if found.shape != (len(part), dimensions):
                    raise ValueError(f"the encoder gave {found.shape} for {len(part)} rows of {dimensions} dimensions")
                length = np.sqrt((found * found).sum(axis=1, keepdims=True))
                if not np.isfinite(length).all() or (length == 0).any():
                    raise ValueError("the encoder gave a zero or non-finite vector")
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": list((found / length).astype(np.float32))})

    return rows.select(key, column).mapInPandas(run, f"{key} {kind}, embedding array<float>")
