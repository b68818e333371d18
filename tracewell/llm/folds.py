"""Folds by id, and monotone calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(id_: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(id_.cast("string")) % folds, F.lit(0)).cast("int")


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``values`` in weighted squares (pool adjacent violators)."""
    means, sizes, counts = [], [], []
    for v, w in zip(values.tolist(), weights.tolist()):
        means.append(v)
        sizes.append(w)
        counts.append(1)
        while len(means) > 1 and means[-2] >= means[-1]:
            m, s, c = means.pop(), sizes.pop(), counts.pop()
            means[-1] = (means[-1] * sizes[-1] + m * s) / (sizes[-1] + s)
            sizes[-1] += s
            counts[-1] += c
    return np.repeat(means, counts)
