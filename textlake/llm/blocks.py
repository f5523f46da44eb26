"""Column blocks: how the operators move numpy columns between tasks.

Work on words, shingles or windows makes far more items than documents. A task sorts its
items by target part and sends one row per (flush, part) whose binary columns hold the
items of that part; Spark shuffles those rows by ``part`` as any others. A part holds its
share of the items, so its memory follows ``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.session import cut_lineage, stored

CHUNK_BYTES = 2 << 20
#: Bytes of an Arrow batch: it stands in the executor's and in the worker's memory at once.
BATCH_BYTES = 4 << 20
#: Bytes of text whose windows a part should hold.
PART_BYTES = 4 << 20
#: What a worker may keep from task to task; a task that needs the memory drops it with ``release``.
worker_cache: dict[str, object] = {}
Batches = Iterator[pa.RecordBatch]


def part_keys(spark: SparkSession, texts: DataFrame | None = None, part_bytes: int = PART_BYTES) -> np.ndarray:
    """One int per shuffle partition, chosen so that each hashes to a partition of its own.

    With ``texts``, there are up to four times as many where the partitions would hold more than
    ``part_bytes`` of their ``text``.
    """
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if texts is not None:
        total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = min(4 * n, max(n, -(-total // part_bytes)))
    found = (spark.range(0, 20 * n + 100, 1, 1).select(F.col("id").cast("int").alias("id"))
             .select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).collect())
    keys = {}
    for r in found:
        keys.setdefault(r["p"], r["id"])
    return np.array([keys.get(p, p) for p in range(n)], dtype=np.int32)


def exchange(df: DataFrame, keys: np.ndarray, fn: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """Shuffle block rows by ``part`` and run ``fn`` once per partition."""
    return df.repartition(len(keys), "part").mapInArrow(fn, schema)


def narrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows and of at most ``BATCH_BYTES``, for all that runs in the session from here on: texts and blocks are large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release(*keep: str) -> None:
    """Drop what earlier tasks of this worker have kept, ``keep`` apart, and hand freed memory back to the system."""
    for name in [n for n in worker_cache if n not in keep]:
        del worker_cache[name]
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def free_prefix(columns: list[str], *names: str) -> str:
    """The shortest run of underscores that makes names which ``columns`` does not have, whatever their case."""
    taken, prefix = {c.lower() for c in columns}, "_"
    while any((prefix + n).lower() in taken for n in names):
        prefix += "_"
    return prefix


def chunks(batches: Batches, text: str = "text", limit: int = CHUNK_BYTES) -> Batches:
    """Cut batches so that the texts of each piece stay near ``limit`` bytes; a longer text is alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.diff(text_bytes(batch.column(text))[1])
        start, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and the n + 1 offsets; null counts as empty."""
    column = (column if column.null_count == 0 else column.fill_null("")).cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def split(part: np.ndarray, n: int, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Items by part, in their order: (part, columns)."""
    order = np.argsort(part, kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=n))
    sorted_columns = [c[order] for c in columns]
    start = 0
    for p, end in enumerate(ends.tolist()):
        if end > start:
            yield p, [c[start:end] for c in sorted_columns]
        start = end


def block(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of rows; numpy values become binary."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array([v.tobytes() if isinstance(v, np.ndarray) else v for v in c], type=f.type)
         for c, f in zip(columns, schema)], schema=schema)


def read(column: pa.Array, dtype) -> np.ndarray:
    """All values of a binary column in one array."""
    parts = [np.frombuffer(v.as_buffer(), dtype) for v in column if v.is_valid and v.as_buffer().size]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def gather(batches: Batches, *columns: tuple[str, type]) -> list[np.ndarray]:
    """The binary columns of a whole partition, each as one array."""
    seen: list[list[np.ndarray]] = [[] for _ in columns]
    for batch in batches:
        for out, (name, dtype) in zip(seen, columns):
            out.append(read(batch.column(name), dtype))
    return [np.concatenate(x) if x else np.zeros(0, dtype) for x, (_, dtype) in zip(seen, columns)]


def task_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length as the last entry."""
    if len(sorted_values) == 0:
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (``a``, ``b``): every end with the smallest id it reaches (``v``, ``root``).

    Each round hooks every root to its smallest neighbour, jumps along the hooks and keeps
    the edges between different roots, so a round removes at least half of the roots.
    Rounds are cut with checkpoint().
    """
    spark = edges.sparkSession
    live = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live = cut_lineage(live)
    labels = live.select(F.explode(F.array("a", "b")).alias("v")).distinct().select("v", F.col("v").alias("root"))
    while not live.isEmpty():
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to"))
        for _ in range(2):
            up = hook.select(F.col("a").alias("to"), F.col("to").alias("top"))
            hook = hook.join(up, "to").select("a", F.col("top").alias("to"))
        hook = cut_lineage(hook)
        labels = cut_lineage(labels.join(hook.withColumnRenamed("a", "root"), "root", "left")
                             .select("v", F.coalesce("to", "root").alias("root")))
        left, right = hook.select("a", F.col("to").alias("x")), hook.select(F.col("a").alias("b"), F.col("to").alias("y"))
        live = cut_lineage(live.join(left, "a").join(right, "b").where("x <> y")
                           .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return labels
