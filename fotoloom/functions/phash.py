"""Perceptual hashes: cosine transform, hash bits and LSH keys."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SIZE = 8


def kth_smallest(a: Column, k: Column | int) -> Column:
    """The k-th smallest element, from 0; null where k is out of bounds."""
    return F.get(F.sort_array(a), k if isinstance(k, Column) else F.lit(k))


def dct_basis(resolution: int, size: int = HASH_SIZE) -> np.ndarray:
    """(size, resolution) rows of the orthonormal DCT-II."""
    x, u = np.arange(resolution), np.arange(size)[:, None]
    basis = np.cos((2 * x + 1) * u * math.pi / (2 * resolution)) * math.sqrt(2 / resolution)
    basis[0] /= math.sqrt(2)
    return basis


def dct_udf(resolution: int, size: int = HASH_SIZE):
    """A vectorized function: raster (row-major, resolution x resolution) to its low-frequency block."""
    basis = dct_basis(resolution, size)

    @F.pandas_udf("array<double>")
    def dct(rasters: pd.Series) -> pd.Series:
        out = np.full(len(rasters), None, dtype=object)
        fit = [i for i, r in enumerate(rasters) if r is not None and len(r) == resolution * resolution]
        if fit:
            x = np.stack([np.asarray(rasters.iloc[i], dtype=np.float64) for i in fit]).reshape(-1, resolution, resolution)
            block = np.einsum("vy,nyx,ux->nvu", basis, x, basis, optimize=True).reshape(len(fit), -1)
            for i, b in zip(fit, block):
                out[i] = b
        return pd.Series(out)

    return dct


def dct_native(raster: Column, resolution: int, size: int = HASH_SIZE) -> Column:
    """The same by higher-order functions, for sessions without Python workers; for small rasters."""
    basis = dct_basis(resolution, size)
    lit = lambda row: F.array(*[F.lit(float(v)) for v in row])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    rows = [F.slice(raster, y * resolution + 1, resolution) for y in range(resolution)]
    dot = lambda row, u: total(F.zip_with(row, lit(basis[u]), lambda p, q: p.cast("double") * q))
    return F.array(*[total(F.array(*[dot(rows[y], u) * F.lit(float(basis[v][y])) for y in range(resolution)])) for v in range(size) for u in range(size)])


def hash_bytes(dct: Column) -> Column:
    """Eight numbers of 0..255: bit i is set where coefficient i exceeds the median of the absolute
    AC coefficients; bits fill each byte from the lowest. Null for fewer than two coefficients."""
    ac = F.slice(dct, F.lit(2), F.greatest(F.size(dct) - 1, F.lit(0)))
    cut = kth_smallest(F.transform(ac, lambda x: F.abs(x)), F.floor((F.size(dct) - 1) / 2).cast("int"))

    def pack(threshold: Column) -> Column:
        def byte(j: Column) -> Column:
            bit = lambda s, i: s + F.when(F.get(dct, j * 8 + i) > threshold, F.pow(F.lit(2), i).cast("int")).otherwise(0)
            return F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), bit)

        return F.transform(F.sequence(F.lit(0), (F.ceil(F.size(dct) / 8) - 1).cast("int")), byte)

    # the threshold is named once, by a one-element array
    packed = F.element_at(F.transform(F.array(cut), pack), 1)
    return F.when(F.size(dct) >= 2, packed)


def hash_hex(dct: Column) -> Column:
    return F.array_join(F.transform(hash_bytes(dct), lambda b: F.lower(F.lpad(F.hex(b), 2, "0"))), "")


def lsh_keys(phash: Column) -> Column:
    """Four 16-bit keys as hex texts, null unless the hash has 16 digits."""
    return F.when(F.length(phash) == 16, F.array(*[F.substring(phash, 4 * i + 1, 4) for i in range(4)]))
