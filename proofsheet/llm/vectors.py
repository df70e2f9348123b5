"""Vectors as whole numbers, for the operators on embeddings."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def finite(v: Column) -> Column:
    """Whether an array is there and holds neither nulls nor non-finite numbers."""
    d = lambda c: c.cast("double")
    return F.coalesce(v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(d(c)) & (F.abs(d(c)) < F.lit(float("inf")))), F.lit(False))


def whole_vectors(df: DataFrame, kept: dict[str, Column], vec_col: str) -> tuple[DataFrame, int]:
    """The columns `kept` and x = floor(256 c), as long, of the rows whose vector is finite and of the most common length; that length.

    Of lengths that are equally common the longer one counts; without rows it is 0.
    """
    v = F.col(f"`{vec_col}`")
    fine = df.filter(finite(v))
    common = fine.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common.d if common else 0
    x = F.transform(v, lambda c: F.floor(c.cast("double") * 256.0).cast("long"))
    return fine.filter(F.size(v) == d).select(*(c.alias(n) for n, c in kept.items()), x.alias("x")), d


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists of equal length as the rows of a matrix of longs."""
    flat = lists.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(lists), -1)
