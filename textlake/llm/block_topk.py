"""Exact top-k inner products by block-at-a-time pruning."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.blocks import narrow_batches, stored
from textlake.llm.vectors import best, is_query, lengths, usable

#: Rows of a block, blocks of a group, queries and group summaries that are bounded together.
BLOCK_ROWS, GROUP_BLOCKS, QUERY_ROWS, SUMMARY_ROWS = 64, 16, 256, 1024


def quantised(table: DataFrame, scale: int = 1024) -> DataFrame:
    """``vec_id`` and ``x``, floor(scale * component) as longs, of usable rows (zeros stay)."""
    return usable(table, zero=True).select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("x"))


def _rows(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Largest possible product of each query with any row of each block: the summed term maxima.

    A component is two terms, its positive and its negative part, so a query adds its weight
    times the block's maximum or minimum, by sign.
    """
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


class Top:
    """The k best (score, id) of one query so far; ties to the smaller id."""

    def __init__(self, k: int, score=None, vec_id=None):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = None if score is None else (score, vec_id)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))
        scores, ids = scores[order], ids[order]
        first = np.sort(np.unique(ids, return_index=True)[1])[:self.k]
        self.scores, self.ids = scores[first], ids[first]
        if len(self.scores) == self.k:
            last = (int(self.scores[-1]), int(self.ids[-1]))
            if self.floor is None or last[0] > self.floor[0] or (last[0] == self.floor[0] and last[1] < self.floor[1]):
                self.floor = last

    def may_hold(self, bound: int, smallest: int) -> bool:
        """Whether a block with this bound and smallest id can still change the result."""
        return self.floor is None or bound > self.floor[0] or (bound == self.floor[0] and smallest <= self.floor[1])


def search_blocks(query: np.ndarray, own: int, top: Top, x: np.ndarray, ids: np.ndarray, starts: np.ndarray,
                  bound: np.ndarray, smallest: np.ndarray) -> None:
    """Score blocks by falling bound until no block left can change the result."""
    for b in np.lexsort((smallest, -bound)):
        if not top.may_hold(int(bound[b]), int(smallest[b])):
            if top.floor is not None and bound[b] < top.floor[0]:
                break
            continue
        lo, hi = starts[b], starts[b + 1]
        scores, some = x[lo:hi] @ query, ids[lo:hi]
        keep = some != own
        top.add(scores[keep], some[keep])


def top_products(table: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the exact k largest inner products of each query.

    ``table`` has ``vec_id`` and ``x`` (see ``quantised``); queries are the rows whose id is divisible by
    100. Rows are ordered by the pattern of their largest components, so that a range of rows has tight
    maxima, and cut into blocks and groups of blocks, stored with their forward index. A query starts with its
    k-th score in its own group; groups whose bound is below it never meet the query. Equal scores go to the
    smaller id; an id that is on several rows counts once, with its best score. A query meets rows of its own length only.
    """
    spark = table.sparkSession
    dims = lengths(table, "x")
    if len(dims) > 1:
        same = [top_products(table.where(F.size("x") == n), k) for n in dims]
        return best(reduce(DataFrame.union, same).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k, False)
    narrow_batches(spark)
    code = F.aggregate(F.slice(F.array_sort(F.transform("x", lambda c, i: F.struct((-F.abs(c)).alias("a"), (i * 2 + (c < 0).cast("int")).alias("i")))), 1, 3),
                       F.lit(0).cast("long"), lambda acc, e: acc * 65536 + e["i"])
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = table.withColumn("code", code).repartitionByRange(n, "code", "vec_id").sortWithinPartitions("code", "vec_id")
    step = BLOCK_ROWS * GROUP_BLOCKS

    def build(batches):
        from textlake.llm.blocks import task_number
        task, number, held, size = task_number(), 0, [], 0

        def group(part: pa.Table) -> pa.RecordBatch:
            x, ids = _rows(part.column("x").combine_chunks()), part.column("vec_id").to_numpy()
            name = (task << 32) + number
            mine = np.flatnonzero(ids % 100 == 0)
            floors, holders = [], []
            for i in mine:
                top = Top(k)
                top.add((x @ x[i])[ids != ids[i]], ids[ids != ids[i]])
                floors.append(top.floor[0] if top.floor else None)
                holders.append(top.floor[1] if top.floor else None)
            q = len(mine)
            return pa.RecordBatch.from_arrays(
                [pa.array([0] + [1] * q, pa.int32()), pa.array([name] * (q + 1)), pa.array([int(ids.min()), *ids[mine].tolist()], pa.int64()),
                 pa.array([x.shape[1]] * (q + 1), pa.int32()), pa.array([x.tobytes(), *[x[i].tobytes() for i in mine]], pa.binary()),
                 pa.array([ids.tobytes()] + [None] * q, pa.binary()), pa.array([x.min(0).tobytes()] + [None] * q, pa.binary()), pa.array([x.max(0).tobytes()] + [None] * q, pa.binary()),
                 pa.array([None, *floors], pa.int64()), pa.array([None, *holders], pa.int64())],
                ["kind", "grp", "id", "dim", "x", "ids", "low", "high", "floor", "holder"])
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            while size >= step:
                whole = pa.Table.from_batches(held)
                yield group(whole.slice(0, step))
                number += 1
                held, size = whole.slice(step).to_batches(), size - step
        if size:
            yield group(pa.Table.from_batches(held))
    index = stored(ranged.mapInArrow(build, "kind int, grp long, id long, dim int, x binary, ids binary, low binary, high binary, floor long, holder long"), "blocks")

    # queries and summaries in blocks of rows; each block of queries meets each block of summaries
    summaries = index.where("kind = 0").select("grp", "id", "low", "high")
    queries = index.where("kind = 1").select("id", "x", "floor", "holder")
    sets = max(1, -(-summaries.count() // SUMMARY_ROWS))
    left = (summaries.withColumn("s", F.pmod(F.xxhash64("grp"), F.lit(sets))).groupBy("s")
            .agg(F.collect_list(F.struct("grp", "id", "low", "high")).alias("groups")))
    lots = max(1, -(-queries.count() // QUERY_ROWS))
    right = (queries.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(lots))).groupBy("q")
             .agg(F.collect_list(F.struct("id", "x", "floor", "holder")).alias("asked"))
             .withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sets - 1).cast("long")))))

    def prune(batches):
        for batch in batches:
            for groups, asked in zip(batch.column("groups").to_pylist(), batch.column("asked").to_pylist()):
                low, high, x = (np.stack([np.frombuffer(r[c], np.int64) for r in rows]) for rows, c in ((groups, "low"), (groups, "high"), (asked, "x")))
                bound = bounds(x, low, high)
                names, smallest = np.array([g["grp"] for g in groups]), np.array([g["id"] for g in groups])
                rows = []
                for i, q in enumerate(asked):
                    keep = np.ones(len(names), bool)
                    if q["floor"] is not None:
                        keep = (bound[i] > q["floor"]) | ((bound[i] == q["floor"]) & (smallest <= q["holder"]))
                    rows += [(int(g), q["id"], q["x"], q["floor"], q["holder"]) for g in names[keep]]
                c = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64())],
                                                 ["grp", "query_id", "x", "floor", "holder"])
    asked = left.join(right, "s").select("groups", "asked").mapInArrow(prune, "grp long, query_id long, x binary, floor long, holder long")

    def search(key, left, right):
        found = ([], [], [])
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            ids = np.frombuffer(left.column("ids")[0].as_py(), np.int64)
            x = np.frombuffer(left.column("x")[0].as_py(), np.int64).reshape(-1, dim)
            starts = np.append(np.arange(0, len(ids), BLOCK_ROWS), len(ids))
            low, high = np.minimum.reduceat(x, starts[:-1]), np.maximum.reduceat(x, starts[:-1])
            smallest = np.minimum.reduceat(ids, starts[:-1])
            for q, raw, floor, holder in zip(*(right.column(c).to_pylist() for c in ("query_id", "x", "floor", "holder"))):
                query = np.frombuffer(raw, np.int64)
                top = Top(k, floor, holder)
                search_blocks(query, q, top, x, ids, starts, bounds(query[None], low, high)[0], smallest)
                for out, values in zip(found, (np.full(len(top.ids), q), top.ids, top.scores)):
                    out.append(values)
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in found]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))
    near = (index.where("kind = 0").select("grp", "dim", "x", "ids").groupBy("grp").cogroup(asked.groupBy("grp"))
            .applyInArrow(search, "query_id long, vec_id long, score long"))
    return best(near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k, False)
