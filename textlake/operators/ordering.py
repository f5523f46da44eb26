"""Numbering and ranking that do not put a hot group into one task.

Rows are cut into value buckets whose bounds come from approximate quantiles. The
bounds only balance the work: results are exact whatever they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucketed(df: DataFrame, by: str, buckets: int | None) -> DataFrame:
    """Add the value bucket ``_b``; by default as many buckets as the session has shuffle partitions."""
    n = buckets or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    qs = F.array(*[F.lit(i / n) for i in range(1, n)])
    found = df.agg(F.percentile_approx(by, qs, max(1000, 10 * n)).alias("b")).first()["b"]
    return df.withColumn("_b", value_bucket(by, sorted(set(found or []))))


def value_bucket(by: str, bounds: list) -> Column:
    """Number of bounds that are at most the value, found by halving; a missing value is in bucket 0."""
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(by) >= F.lit(bounds[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))
    return search(0, len(bounds))


def _join(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """Inner join on equal values, missing ones included."""
    named = right.withColumnsRenamed({c: f"_r_{c}" for c in cols})
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in cols])
    return left.join(named, on).drop(*[f"_r_{c}" for c in cols])


def number_rows(df: DataFrame, by: str, keys: list[str] | None = None, buckets: int | None = None,
                out: str = "rn") -> DataFrame:
    """1-based row number by a unique numeric column, per key or over the whole table.

    Each (key, bucket) is numbered on its own; rows in earlier buckets are added from
    a count per (key, bucket), which is small.
    """
    keys = keys or []
    b = _bucketed(df, by, buckets)
    local = b.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(by)))
    counts = b.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    skip = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_skip"))
    return _join(local, skip, [*keys, "_b"]).withColumn(out, F.col("_skip") + F.col("_rn")).drop("_b", "_rn", "_skip")


def rank_values(df: DataFrame, keys: list[str], by: str, buckets: int | None = None) -> DataFrame:
    """``rank, dense_rank, percent_rank, cume_dist`` of every row, ascending by a numeric column.

    All four depend on the value only, so rows are first counted per (key, value); the
    running counts go over distinct values in buckets, and the ranks join back.
    """
    per_value = _bucketed(df.groupBy(*keys, by).agg(F.count("*").alias("_n")), by, buckets)
    inside = Window.partitionBy(*keys, "_b").orderBy(by)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = per_value.withColumns({"_lt": F.coalesce(F.sum("_n").over(before), F.lit(0)),
                                   "_dr": F.row_number().over(inside)})
    totals = per_value.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"), F.count("*").alias("_bd"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    skip = totals.select(*keys, "_b", F.coalesce(F.sum("_bn").over(earlier), F.lit(0)).alias("_sn"),
                         F.coalesce(F.sum("_bd").over(earlier), F.lit(0)).alias("_sd"),
                         F.sum("_bn").over(Window.partitionBy(*keys)).alias("_all"))
    ranks = (_join(local, skip, [*keys, "_b"])
             .withColumns({"_less": F.col("_sn") + F.col("_lt")})
             .select(*keys, by, (F.col("_less") + 1).alias("rank"), (F.col("_sd") + F.col("_dr")).alias("dense_rank"),
                     F.when(F.col("_all") > 1, F.col("_less") / (F.col("_all") - 1)).otherwise(F.lit(0.0)).alias("percent_rank"),
                     ((F.col("_less") + F.col("_n")) / F.col("_all")).alias("cume_dist")))
    return _join(df, ranks, [*keys, by])


def neighbours(df: DataFrame, keys: list[str], by: str, value: str, buckets: int | None = None) -> DataFrame:
    """Previous and next ``value`` by a unique numeric column, per key.

    Buckets are scanned on their own; the edge rows of a bucket take theirs from the
    nearest filled bucket, found in a table of one row per (key, bucket).
    """
    b = _bucketed(df, by, buckets)
    inside = Window.partitionBy(*keys, "_b").orderBy(by)
    local = b.withColumns({"_prev": F.lag(value).over(inside), "_next": F.lead(value).over(inside),
                           "_first": F.row_number().over(inside) == 1,
                           "_last": F.lead(by).over(inside).isNull()})
    edges = b.groupBy(*keys, "_b").agg(F.min_by(value, by).alias("_head"), F.max_by(value, by).alias("_tail"))
    w = Window.partitionBy(*keys).orderBy("_b")
    edges = edges.select(*keys, "_b", F.lag("_tail").over(w).alias("_pe"), F.lead("_head").over(w).alias("_ne"))
    return (_join(local, edges, [*keys, "_b"])
            .withColumn(f"prev_{value}", F.when(F.col("_first"), F.col("_pe")).otherwise(F.col("_prev")))
            .withColumn(f"next_{value}", F.when(F.col("_last"), F.col("_ne")).otherwise(F.col("_next")))
            .drop("_b", "_prev", "_next", "_first", "_last", "_pe", "_ne"))
