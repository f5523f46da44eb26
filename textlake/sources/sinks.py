"""Writers for row texts, sentences, corpora and results."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.functions.text import strip_tags
from textlake.sources.readers import RECORD_SEPARATOR, cast_declared, value_text


def kv_text(df: DataFrame, names: dict[str, str] | None = None) -> Column:
    """``name: value`` lines of a row; NULL reads ``NULL``."""
    names = names or {}
    return F.concat_ws("\n", *[
        F.concat(F.lit(f"{names.get(f.name, f.name)}: "),
                 F.coalesce(value_text(F.col(f.name), f.dataType), F.lit("NULL")))
        for f in df.schema.fields])


def export_kv_rows(df: DataFrame, path: str, names: dict[str, str] | None = None) -> None:
    df.select(kv_text(df, names).alias("value")).write.option("lineSep", RECORD_SEPARATOR).text(path)


def to_multi_column(sentences: DataFrame, fields: list[str], key: str = "row_id") -> DataFrame:
    """One column per field holding its sentence, empty when missing; the field list is given, so one pass."""
    wide = sentences.groupBy(key).pivot("field", fields).agg(F.min_by("sentence", "pos") if "pos" in sentences.columns else F.min("sentence"))
    return wide.na.fill("", subset=fields)


def to_single_column(sentences: DataFrame) -> DataFrame:
    return sentences.select("row_id", F.col("field").alias("field_name"), "sentence")


def write_corpus(docs: DataFrame, path: str, as_files: bool = False) -> None:
    """Documents with tags stripped, as parquet.

    ``as_files`` writes one ``.txt`` per document from the tasks; ``path`` must then be a
    mount every executor shares. Rewriting a lost task's files gives the same content.
    """
    clean = docs.select("filename", strip_tags(F.col("contents")).alias("contents"))
    if not as_files:
        clean.write.parquet(path)
        return
    os.makedirs(path, exist_ok=True)

    def save(rows) -> None:
        for row in rows:
            target = os.path.join(path, row.filename)
            with open(partial := f"{target}.{uuid.uuid4().hex}", "w", encoding="utf-8") as out:
                out.write(row.contents)
            os.replace(partial, target)
    clean.foreachPartition(save)


def split_existing(new: DataFrame, existing: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of ``new`` still to produce, and counts of produced and skipped keys."""
    have = existing.select(*keys).distinct().withColumn("_have", F.lit(True))
    marked = new.join(have, keys, "left")
    todo = marked.where(F.col("_have").isNull()).drop("_have")
    counts = marked.groupBy(F.when(F.col("_have"), "skipped").otherwise("produced").alias("status")).agg(
        F.count("*").alias("n"))
    return todo, counts


def append_missing(new: DataFrame, existing: DataFrame, keys: list[str], path: str) -> None:
    todo, _ = split_existing(new, existing, keys)
    todo.write.mode("append").parquet(path)


def metrics_export(metrics: DataFrame, cut: int | None = None) -> DataFrame:
    """Per-question rows for the report file; answers are whole unless ``cut`` characters are asked for."""
    texts = {c: F.array_join(c, ", ") for c in ("extracted", "ground_truth")}
    return metrics.withColumns({c: t if cut is None else F.substring(t, 1, cut) for c, t in texts.items()})


def write_metrics(metrics: DataFrame, summary: DataFrame, path: str) -> None:
    metrics_export(metrics).write.csv(f"{path}/metrics", header=True)
    summary.write.csv(f"{path}/summary", header=True)


RESULT_LAYOUT = ["system", "null_mode", "noise_ratio", "n_documents"]


def write_results(results: DataFrame, path: str) -> None:
    """Results partitioned by system, null mode, noise ratio and number of documents."""
    missing = {"system": "default", "null_mode": "default", "noise_ratio": "1_data_0_noise", "n_documents": 0}
    for name, value in missing.items():
        current = F.col(name) if name in results.columns else F.lit(None)
        results = results.withColumn(name, F.coalesce(current, F.lit(value)))
    results.write.mode("append").partitionBy(*RESULT_LAYOUT).parquet(path)


def mode_folder(null_mode: Column, binary_mode: Column) -> Column:
    return (F.when((null_mode == "explicit") & (binary_mode == "explicit"), "null_binary_explicit")
            .when((null_mode == "explicit") & (binary_mode == "implicit"), "null_explicit_binary_implicit")
            .when((null_mode == "implicit") & (binary_mode == "explicit"), "null_implicit_binary_explicit")
            .otherwise("null_binary_implicit"))


def ratio_folder(x: Column, y: Column) -> Column:
    return F.concat(x.cast("string"), F.lit("_data_"), y.cast("string"), F.lit("_noise"))


def parse_ratio_folder(name: Column) -> tuple[Column, Column]:
    pattern = r"^(\d+)_data_(\d+)_noise$"
    return tuple(F.regexp_extract(name, pattern, g).try_cast("int") for g in (1, 2))


def parse_ratio(text: Column, default: tuple[int, int] = (1, 0)) -> tuple[Column, Column]:
    """``X:Y`` as two numbers, the default pair when malformed."""
    pattern = r"^\s*([+-]?\d+)\s*:\s*([+-]?\d+)\s*$"
    ok = F.coalesce(text.rlike(pattern), F.lit(False))
    return tuple(F.when(ok, F.regexp_extract(text, pattern, g).try_cast("int")).otherwise(F.lit(d))
                 for g, d in zip((1, 2), default))


def copy_table(df: DataFrame, declared: dict[str, str], path: str) -> int:
    """Copy a table with mapped types; the row count is observed during the write."""
    from pyspark.sql import Observation
    seen = Observation("copied")
    cast_declared(df, declared).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return int(seen.get["n"])


def write_bank(rows: DataFrame, path: str, tags: DataFrame | None = None) -> None:
    """Banks as JSON, one object a table, in the layout that ``read_bank`` and ``read_tags`` read.

    ``rows``: (database, table) and the columns of ``bank_to_df``; ``tags``: (database, table, tag, field, replacement).
    A bank has the size of a column list, so one object holds it; the tables are spread over the tasks.
    """
    keys = ["database", "table"]

    def pool(name: str) -> Column:
        of = F.array_sort(F.filter("words", lambda w: (w["pool"] == name) & w["pattern"].isNotNull()))
        return F.transform(of, lambda w: w["pattern"])
    slots = rows.groupBy(*keys, "pos").agg(
        F.collect_list(F.struct("vid", "pool", "pattern")).alias("words"),
        *[F.any_value(c).alias(c) for c in ("field", "others", "variation_class", "synonyms")])
    std = pool("std")
    template = F.struct(
        "pos", F.get(std, F.lit(0)).alias("original"), F.get(std, F.lit(0)).alias("template_pattern"),
        F.array_compact(F.array("field")).alias("primary_data_fields"), F.col("others").alias("foreign_data_fields"), "variation_class",
        std.alias("variations"), pool("counter").alias("counter_variations"), pool("null").alias("null_variations"),
        F.col("synonyms").alias("lexical_sets"), F.col("field").isNull().alias("is_static"))
    # maps cannot be ordered, so the templates are sorted by a comparison of their places
    by_place = F.array_sort(F.collect_list(template), lambda a, b: a["pos"] - b["pos"])
    banks = slots.groupBy(*keys).agg(by_place.alias("templates"))
    banks = banks.withColumn("templates", F.transform("templates", lambda t: t.dropFields("pos")))
    if tags is not None:
        maps = tags.groupBy(*keys).agg(*[F.map_from_entries(F.collect_set(F.struct("tag", c))).alias(name) for c, name in (
            ("field", "hash_to_column"), ("replacement", "hash_to_replacement"))])
        banks = banks.join(maps, keys, "left")
    banks.write.json(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
