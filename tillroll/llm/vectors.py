"""Vectors of whole numbers and their inner products, exact at any size."""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE = "decimal(38,0)"
WIDEST = 10**38 - 1  # scores beyond are counted as this
LONG = 2**63 - 1
NO_ID = 1 << 63  # stands for a missing id: last among equal scores


def usable(vector: Column) -> Column:
    """Whether the vector is there and all its components are there and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return vector.isNotNull() & finite


def whole_vectors(flat: np.ndarray, dim: int, factor: int) -> np.ndarray:
    """floor(factor * x) as doubles where every inner product of two rows is exact in them, as
    64-bit integers where it fits those, else as Python's integers."""
    given = flat.astype(np.float64).reshape(-1, dim)
    with np.errstate(over="ignore"):
        scaled = np.floor(given * factor)
        largest = float(np.abs(scaled).max()) if scaled.size else 0.0
        bound = largest * largest * max(1, dim)
    if bound < 2.0**52:
        return scaled
    if bound < 2.0**62:
        return scaled.astype(np.int64)
    wide = np.empty(scaled.shape, dtype=object)
    for place, x in np.ndenumerate(scaled):
        wide[place] = int(x) if math.isfinite(x) else int(given[place]) * factor
    return wide


def group_vectors(table: pa.Table, factor: int) -> np.ndarray:
    """The ``vector`` column of rows that share one ``dim``, as whole numbers."""
    dim = int(table.column("dim")[0].as_py())
    if not dim:
        return np.zeros((table.num_rows, 0))
    return whole_vectors(table.column("vector").combine_chunks().flatten().to_numpy(), dim, factor)


def as_score(product: float) -> Decimal:
    return Decimal(max(-WIDEST, min(WIDEST, int(product))))


def as_long(score: Column) -> Column:
    """The score, or the nearest long."""
    return F.greatest(F.least(score, F.lit(LONG).cast(SCORE)), F.lit(-LONG - 1).cast(SCORE)).cast("bigint")
