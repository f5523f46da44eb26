"""Integrity statistics of a rendered corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def column_diff(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Missing and extra fields per key and whether the order agrees: both sides are (…keys, ordinal, field)."""
    def ordered(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "field"))),
                                                 lambda x: x["field"]).alias(name))
    both = ordered(expected, "want").join(ordered(actual, "got"), keys, "full")
    empty = F.array().cast("array<string>")
    both = both.withColumns({"want": F.coalesce("want", empty), "got": F.coalesce("got", empty)})
    return both.select(*keys, F.array_sort(F.array_except("want", "got")).alias("missing"),
                       F.array_sort(F.array_except("got", "want")).alias("extra"),
                       (F.col("want") == F.col("got")).alias("same_order"))


def sentence_uniqueness(corpus: DataFrame, sentences: str = "sentences") -> DataFrame:
    """Mean duplicates per document, distinct sentences in all, and their share.

    Sentences are told apart by their SHA-256, so that 32 bytes of each are shuffled, and are combined map-side.
    """
    rows = corpus.select(F.size(sentences).alias("n"),
                         (F.size(sentences) - F.size(F.array_distinct(sentences))).alias("dup")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_all"), F.sum("dup").alias("n_dup"))
    each = corpus.select(F.explode(F.array_distinct(sentences)).alias("s")).select(F.unhex(F.sha2("s", 256)).alias("h"))
    distinct = each.distinct().agg(F.count(F.lit(1)).alias("d"))
    return rows.select("n_docs", "n_all", F.round(F.col("n_dup") / F.col("n_docs"), 6).alias("mean_duplicates"),
                       distinct.scalar().alias("n_distinct")).withColumn(
        "distinct_ratio", F.round(F.try_divide("n_distinct", "n_all"), 6))


def has_unfilled_mark(text: Column) -> Column:
    return text.rlike(r"\[([^\]]+)\]")


def unfilled_placeholders(corpus: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct rows that still hold a mark."""
    return corpus.where(has_unfilled_mark(F.col(text))).select(key).distinct()


def sentence_quality(sentences: DataFrame, text: str = "sentence", keys: list[str] | None = None) -> DataFrame:
    """Mean length, sentences with a proper end and sentences that look as if they held data."""
    s = F.col(text)
    data_like = s.rlike(r"\d+|[A-Z][a-z]+\s+[A-Z][a-z]+|%")
    return sentences.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.length(s)) / F.count(F.lit(1)), 6).alias("mean_length"),
        F.count_if(s.rlike(r"[.!?]$")).alias("proper_ends"), F.count_if(data_like).alias("data_like"))


def uses_schema_language(text: Column) -> Column:
    return F.lower(text).rlike("row value|database|table|field value|data entry")


def schema_language(corpus: DataFrame, key: str, text: str) -> DataFrame:
    return corpus.where(uses_schema_language(F.col(text))).select(key).distinct()


