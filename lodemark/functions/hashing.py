"""Hashes as Column expressions: Hamming distance, stable shares and splits, image fingerprints."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hex_to_long(c: Column) -> Column:
    """16 hex digits as a signed 64-bit number; '' gives null."""
    return F.when(c != "", F.conv(c, 16, -10).cast("long"))


def hamming64(a: Column, b: Column) -> Column:
    """Differing bits of two longs; 64 if either is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)).cast("int"), F.lit(64))


def hamming_hex64(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints of 16 hex digits; 64 if either is empty."""
    return hamming64(hex_to_long(a), hex_to_long(b))


def stable_rank(key: Column, seed: int) -> Column:
    """A digest by which rows can be put in an order that only the seed changes."""
    return F.sha2(F.concat_ws("::", F.lit(str(seed)), key), 256)


def unit_interval(key: Column, seed: int) -> Column:
    """A share in [0, 1) from the first 32 bits of the digest."""
    return F.conv(F.substring(stable_rank(key, seed), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def hash_split(key: Column, seed: int = 42, train: float = 0.7, val: float = 0.15, test: float = 0.15) -> Column:
    """train, val or test by the key's share; the ratios have to add up to 1."""
    if abs(train + val + test - 1) > 1e-6:
        raise ValueError(f"split ratios add up to {train + val + test}, not 1")
    share = unit_interval(key, seed)
    return F.when(share < train, "train").when(share < train + val, "val").otherwise("test")


def gray(pixels: np.ndarray) -> np.ndarray:
    """Luma of an RGB image (h, w, 3) in whole numbers."""
    return (pixels.astype(np.int64) @ np.array([19595, 38470, 7471]) + 32768) >> 16


def _lanczos(n: int, m: int) -> np.ndarray:
    """Whole-number weights (m, n), in units of 2^-22, that resample n samples to m by a Lanczos window of three lobes."""
    scale = n / m
    wide = max(scale, 1.0)
    out = np.zeros((m, n), np.int64)
    for i in range(m):
        centre = (i + 0.5) * scale
        low, high = max(0, int(centre - 3 * wide + 0.5)), min(n, int(centre + 3 * wide + 0.5))
        x = (np.arange(low, high) + 0.5 - centre) / wide
        w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
        w = w / w.sum() * (1 << 22)
        out[i, low:high] = np.trunc(w + np.copysign(0.5, w))
    return out


def _resampled(x: np.ndarray, n: int) -> np.ndarray:
    """The columns of an image of bytes resampled to n, rounded and kept within a byte."""
    if x.shape[1] == n:
        return x
    return np.clip((x @ _lanczos(x.shape[1], n).T + (1 << 21)) >> 22, 0, 255)


def dhash64(pixels: np.ndarray, size: int = 8) -> str:
    """Difference hash: the image gray and resampled to size rows of size + 1; a bit says that the right one is lighter.

    Gray and the resampling (columns, then rows, each rounded to bytes) are done in the whole numbers that common image
    libraries use, so equal pixels give equal bits.
    """
    small = _resampled(_resampled(gray(pixels), size + 1).T, size).T
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):0{size * size // 4}x}"


def dhash_of_image(image: Column) -> Column:
    """Fingerprints of Spark image structs (rows of blue, green, red bytes); '' of what wasn't decoded."""

    @F.pandas_udf(T.StringType())
    def hashed(images: pd.DataFrame) -> pd.Series:
        out = []
        for h, w, n, data in zip(images["height"], images["width"], images["nChannels"], images["data"]):
            if h is None or h <= 0 or w <= 0:
                out.append("")
                continue
            x = np.frombuffer(data, np.uint8).reshape(h, w, n)
            out.append(dhash64(np.repeat(x, 3, axis=2) if n == 1 else x[:, :, 2::-1]))
        return pd.Series(out, dtype=object)

    return hashed(image)
