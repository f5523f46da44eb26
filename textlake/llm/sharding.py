"""Reproducible shuffle into shards: a Feistel permutation over global row numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.blocks import mix, narrow_batches, stored

ROUNDS = 8


def permute(rows: np.ndarray, n: int, seed: int = 42) -> np.ndarray:
    """Place of each row number in a random order of 0 .. n - 1.

    Balanced Feistel rounds permute the numbers below the next power of four; numbers that
    leave 0 .. n - 1 are walked along their cycle until they are back inside.
    """
    half = max(1, ((n - 1).bit_length() + 1) // 2) if n > 1 else 1
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for key in keys:
            left, right = right, left ^ (mix(right + key) & mask)
        return (left << shift) | right
    out = once(rows.astype(np.uint64))
    outside = np.flatnonzero(out >= n)
    while len(outside):
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= n]
    return out.astype(np.int64)


def numbered(df: DataFrame, by: list[str]) -> DataFrame:
    """Add ``_row``, the global row number (from 0) in the order of ``by``, without one task for all.

    Rows are sorted by ranges and stored with their range and place there; the ranges'
    counts (one row each) give the offsets.
    """
    def place(batches):
        from textlake.llm.blocks import task_number
        task, n = task_number(), 0
        for batch in batches:
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(k, task, np.int64)), pa.array(np.arange(n, n + k))],
                                             [*batch.schema.names, "_range", "_place"])
            n += k
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", _range long, _place long"
    placed = stored(df.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(place, schema), "numbered")
    sizes = sorted((r["_range"], r["n"]) for r in placed.groupBy("_range").agg(F.count("*").alias("n")).collect())
    skip, total = {}, 0
    for key, size in sizes:
        skip[key], total = total, total + size
    start = F.create_map(*[F.lit(x) for kv in skip.items() for x in kv]) if skip else F.lit(None)
    first = F.coalesce(F.element_at(start, F.col("_range")), F.lit(0)) if skip else F.lit(0)
    return placed.select(*df.columns, (first + F.col("_place")).cast("long").alias("_row"))


def shard(docs: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """Shards whose counts are at most one apart: document r goes to place permute(r), that is
    shard ``place % shards`` and slot ``place // shards``. Both can be computed for any row.

    Documents are numbered by doc_id (null first), then text checksum and size; equal rows
    may change places. A null text has size 1 and checksum 0. An empty table gives no rows.
    """
    narrow_batches(docs.sparkSession)
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).cast("long").alias("text_crc32"))
    rows = numbered(slim, ["doc_id", "text_crc32", "size"])
    n = rows.count()

    def deal(batches):
        for batch in batches:
            place = permute(batch.column("_row").to_numpy(), n, seed)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array((place % shards).astype(np.int32)), pa.array(place // shards)],
                                             ["doc_id", "size", "text_crc32", "shard", "slot"])
    dealt = rows.mapInArrow(deal, "doc_id long, size long, text_crc32 long, shard int, slot long")
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
