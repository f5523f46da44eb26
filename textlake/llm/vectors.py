"""Vectors in blocks: cleaning, and the last merge of a search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", zero: bool = False) -> DataFrame:
    """``vec_id`` and ``v`` (array of doubles) of the rows that take part in a search.

    Left out: null ids, null or empty vectors, vectors with a null or non-finite component and, unless ``zero``,
    vectors of zeros.
    """
    v = F.col("v")
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    fine = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(fine if zero else fine & F.exists(v, lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of doubles, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


#: Different lengths of vectors that a table may hold; more raise an error.
MAX_LENGTHS = 64


def lengths(table: DataFrame, column: str) -> list[int]:
    """The lengths of the vectors, at most ``MAX_LENGTHS``."""
    found = [r["n"] for r in table.select(F.size(column).alias("n")).distinct().limit(MAX_LENGTHS + 1).collect()]
    if len(found) > MAX_LENGTHS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} different lengths")
    return sorted(found)


def is_query(vec_id: str = "vec_id"):
    return F.pmod(F.col(vec_id), F.lit(100)) == 0


def best(found: DataFrame, k: int, ascending: bool) -> DataFrame:
    """The k best of each query (``query_id, vec_id, score``), ties to the smaller id, as ``rank`` from 1.

    ``found`` holds at most k rows for each query and task that looked for it.
    """
    order = F.col("score").asc() if ascending else F.col("score").desc()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return (found.withColumn("rank", place).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
