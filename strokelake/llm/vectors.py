"""Vectors as whole numbers: the rows that take part, and their numbers inside Arrow functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int, square: Column | float, *more: Column) -> DataFrame:
    """``_id, _vector`` and ``more``: each component x as floor(scale * x), for vectors without a null or non-finite component.

    ``square`` bounds the square of a number, so that sums of squares stay in 64 bits; a vector beyond it has no exact score
    in a long and takes no part, as a null vector takes none.
    """
    most = F.sqrt(F.lit(square)) - 1 if not isinstance(square, Column) else F.sqrt(square) - 1
    fits = F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) <= most))
    numbers = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return rows.filter(fits).select(F.col(id_col).alias("_id"), numbers.alias("_vector"), *more)


def matrix(column, dims: int) -> np.ndarray:
    """The rows of an Arrow list column whose lists all have ``dims`` numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)
