"""Approximate nearest neighbours by cross-polytope hashing with multiprobe and exact reranking."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.blocks import mix, narrow_batches, stored
from textlake.llm.vectors import best, is_query, lengths, matrix, usable

#: Rows of one cell that a task compares at a time; larger cells are cut.
CELL_ROWS = 512


def signs(dim: int, tables: int, seed: int) -> np.ndarray:
    """Random signs (tables, 3, dim) of the pseudo-rotations."""
    bits = mix(np.arange(tables * 3 * dim, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003) + np.uint64(1))
    return np.where(bits & np.uint64(1), 1.0, -1.0).reshape(tables, 3, dim)


def rotate(x: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Three rounds of signs and a fast Hadamard transform; the width is a power of two."""
    for s in sign:
        x = x * s
        n, h = x.shape[1], 1
        while h < n:
            y = x.reshape(len(x), n // (2 * h), 2, h)
            x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(len(x), n)
            h *= 2
        x = x / math.sqrt(n)
    return x


def cells(vectors: np.ndarray, sign: np.ndarray, probes: int) -> np.ndarray:
    """Cells (rows, tables, probes) of each vector's direction: signed axes, nearest first."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    wide = np.zeros((len(unit), sign.shape[2]))
    wide[:, :unit.shape[1]] = unit
    out = np.empty((len(unit), len(sign), probes), np.int64)
    for t, s in enumerate(sign):
        y = rotate(wide, s)
        both = np.concatenate([y, -y], 1)
        out[:, t] = np.argsort(-both, axis=1, kind="stable")[:, :probes]
    return out


def _explode(rows: DataFrame, sign: np.ndarray, probes: int) -> DataFrame:
    """One row per table and probed cell: ``cell, vec_id, v``."""
    shared = rows.sparkSession.sparkContext.broadcast(sign)

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            own = cells(matrix(batch.column("v")), shared.value, probes)
            cell = (own + np.arange(own.shape[1])[None, :, None] * (2 * sign.shape[2])).reshape(batch.num_rows, -1)
            at = pa.array(np.repeat(np.arange(batch.num_rows), cell.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(cell.ravel()), batch.column("vec_id").take(at), batch.column("v").take(at)], ["cell", "vec_id", "v"])
    return rows.mapInArrow(run, "cell long, vec_id long, v array<double>")


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact Euclidean distances, by differences (no cancellation)."""
    return np.sqrt(((q[:, None, :] - x[None, :, :]) ** 2).sum(2))


def _closest(query_ids, queries, ids, rows, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each query among the rows, its own id apart; products choose, differences rank."""
    out = ([], [], [])
    norms = (rows ** 2).sum(1)
    for lo in range(0, len(queries), 256):
        q, q_ids = queries[lo:lo + 256], query_ids[lo:lo + 256]
        rough = norms[None, :] - 2 * (q @ rows.T)
        rough[q_ids[:, None] == ids[None, :]] = np.inf
        m = min(k, len(rows))
        bound = np.partition(rough, m - 1, axis=1)[:, m - 1]
        slack = 1e-9 * (norms.max() + (q ** 2).sum(1)) + 1e-12
        near = (rough <= (bound + slack)[:, None]) & np.isfinite(rough)
        for i in range(len(q)):
            at = np.flatnonzero(near[i])
            d = _distances(q[i:i + 1], rows[at])[0]
            pick = np.lexsort((ids[at], d))[:k]
            out[0].append(np.full(len(pick), q_ids[i]))
            out[1].append(ids[at][pick])
            out[2].append(d[pick])
    return tuple(np.concatenate(x) for x in out) if out[0] else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


_FOUND = "query_id long, vec_id long, score double"


def _compare(cells_: DataFrame, probes: DataFrame, by: list[str], k: int) -> DataFrame:
    """Exact distances of the queries and rows that share ``by``: k rows per query and group."""
    def run(key, left, right):
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        got = _closest(right.column("vec_id").to_numpy(), matrix(right.column("v").combine_chunks()),
                       left.column("vec_id").to_numpy(), matrix(left.column("v").combine_chunks()), k)
        return pa.table({"query_id": got[0], "vec_id": got[1], "score": got[2]})
    return cells_.groupBy(*by).cogroup(probes.groupBy(*by)).applyInArrow(run, _FOUND)


def _cut(rows: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their share ``cut`` of a large cell, and the number of shares of each cell."""
    sizes = rows.groupBy(by).agg(F.ceil(F.count("*") / CELL_ROWS).cast("long").alias("cuts"))
    return rows.join(sizes, by).withColumn("cut", F.pmod(F.xxhash64("vec_id"), F.col("cuts"))).drop("cuts"), sizes


def nearest(table: DataFrame, queries: DataFrame | None = None, k: int = 10, tables: int = 10, probes: int = 12, seed: int = 7) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the k nearest rows found, by Euclidean distance.

    ``table`` has ``vec_id`` and ``v`` (see ``usable``), ``queries`` too (else the rows whose id is divisible by 100).
    Every row is in one cell of each table, a query looks into ``probes`` cells of each. A query with fewer
    than k rows in its cells is compared with all rows, in blocks. Equal distances go to the
    smaller id; an id that is on several rows counts once, with its smallest distance. A query is compared
    with rows of its own length only. No rows or queries: no rows.
    """
    spark = table.sparkSession
    narrow_batches(spark)
    table = stored(table, "vectors")
    queries = stored(table.where(is_query()) if queries is None else queries, "queries")
    dims = lengths(table, "v")
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if len(dims) > 1:
        same = [nearest(table.where(F.size("v") == n), queries.where(F.size("v") == n), k, tables, probes, seed) for n in dims]
        return best(reduce(DataFrame.union, same).groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), k, True)
    queries = queries.where(F.size("v") == dims[0])
    width = 1 << max(1, (dims[0] - 1).bit_length())
    sign = signs(width, tables, seed)
    rows, sizes = _cut(_explode(table, sign, 1), "cell")
    looks = (_explode(queries, sign, min(probes, 2 * width)).join(sizes, "cell")
             .select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cut"), "vec_id", "v"))
    near = stored(_compare(rows, looks, ["cell", "cut"], k).groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), "near")
    counts = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = queries.join(counts, "vec_id", "left_anti")
    if short.isEmpty():
        return best(near, k, True)
    # the few queries that the cells leave short: against all rows, in blocks of rows
    blocks = max(1, -(-table.count() // CELL_ROWS))
    pieces = table.withColumn("cut", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    asked = short.withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    rest = _compare(pieces, asked, ["cut"], k)
    return best(near.union(rest).groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), k, True)
