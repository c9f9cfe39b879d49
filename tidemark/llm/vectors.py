"""Vector columns: which rows take part, and how batches become arrays."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str = "embedding") -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    v = F.col(column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    """Rows of one dimension as doubles."""
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.empty((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Scaled first, so that huge or tiny components neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sample(vectors: DataFrame, rows: int, id_column: str = "vec_id") -> DataFrame:
    """A bounded sample: the rows with the smallest id hashes."""
    return vectors.orderBy(F.xxhash64(id_column), id_column).limit(rows)
