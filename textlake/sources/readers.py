"""Readers for tables, row texts, corpora, templates, banks and workloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD_SEPARATOR = "\x1e"


def value_text(c: Column, dtype: T.DataType) -> Column:
    """Shortest plain text of a value; doubles never show an exponent."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.call_function("format_number", c.cast("double"), F.lit("0.0###############"))
    return c.cast("string")


def read_table(df: DataFrame, order_key: str | None = None, limit: int | None = None,
               as_text: bool = False) -> DataFrame:
    """A table, or its first ``limit`` rows by key; ``as_text`` writes every value as text."""
    if limit is not None:
        df = df.orderBy(order_key).limit(limit)
    if as_text:
        df = df.select(*[F.coalesce(value_text(F.col(f.name), f.dataType), F.lit("NULL")).alias(f.name)
                         for f in df.schema.fields])
    return df


def column_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column: position, type, rows seen and whether a value is ever missing.

    One aggregate per table, so the only rows that move are one per scan task.
    """
    def one(name: str, df: DataFrame) -> DataFrame:
        counts = df.agg(F.count(F.lit(1)).alias("n_rows"),
                        *[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
        entries = [F.struct(F.lit(i + 1).alias("ordinal"), F.lit(f.name).alias("column_name"),
                            F.lit(f.dataType.simpleString()).alias("data_type"),
                            (F.col(f"c{i}") == F.col("n_rows")).alias("not_null"))
                   for i, f in enumerate(df.schema.fields)]
        return (counts.select("n_rows", F.explode(F.array(*entries)).alias("e"))
                .select(F.lit(name).alias("table_name"), "e.*", "n_rows"))
    return reduce(DataFrame.unionByName, [one(n, d) for n, d in tables.items()])


def parse_kv(content: Column) -> Column:
    """Map of ``key: value`` lines, split at the first colon; other lines are dropped, and the last line of a key counts."""
    lines = F.filter(F.split(content, "\n"), lambda s: s.contains(":"))
    entries = F.transform(lines, lambda s: F.struct(
        F.trim(F.split_part(s, F.lit(":"), F.lit(1))).alias("key"),
        F.trim(F.substring(s, F.instr(s, ":") + 1, F.length(s))).alias("value")))
    later = F.transform(entries, lambda e: e["key"])
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(later, i + 2, F.size(later)), e["key"]))
    return F.map_from_entries(last)


def read_kv_rows(spark: SparkSession, path: str, one_file_per_row: bool = False) -> DataFrame:
    """Row texts as ``(content, fields)``, from record-separated files or one small file per row."""
    if one_file_per_row:
        raw = spark.read.text(path, wholetext=True)
    else:
        raw = spark.read.text(path, lineSep=RECORD_SEPARATOR)
    return (raw.select(F.col("value").alias("content")).where(F.trim("content") != "")
            .withColumn("fields", parse_kv(F.col("content"))))


def file_number(name: Column) -> Column:
    """First number in a file name, 0 when there is none."""
    return F.coalesce(F.regexp_extract(name, r"(\d+)", 1).try_cast("bigint"), F.lit(0))


def read_corpus(spark: SparkSession, path: str, max_docs: int = 0, layout: str = "parquet") -> DataFrame:
    """Documents ``(row_id, filename, contents)`` from parquet or a folder of ``*.txt`` files (``files``)."""
    if layout == "files":
        docs = (spark.read.text(path, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True)
                .select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("contents")))
    else:
        docs = spark.read.parquet(path)
    docs = docs.select(file_number(F.col("filename")).alias("row_id"), "filename", "contents")
    return docs.orderBy("row_id", "filename").limit(max_docs) if max_docs else docs


SENTENCE_TEMPLATE = T.StructType([
    T.StructField("database", T.StringType()), T.StructField("table", T.StringType()),
    T.StructField("entry_index", T.IntegerType()),
    T.StructField("original_data", T.MapType(T.StringType(), T.StringType())),
    T.StructField("generated_sentences", T.ArrayType(T.StringType())),
    T.StructField("null_mode", T.StringType()), T.StructField("binary_mode", T.StringType()),
    T.StructField("data_noise_ratio", T.StringType()),
    T.StructField("tbd_columns", T.ArrayType(T.StringType())),
    T.StructField("hash_to_column", T.MapType(T.StringType(), T.StringType())),
])

NARRATIVE = T.StructType([
    T.StructField("database", T.StringType()), T.StructField("table", T.StringType()),
    T.StructField("narrative", T.ArrayType(T.StringType())),
    T.StructField("data_noise_ratio", T.StringType()),
    T.StructField("data_sentence_count", T.IntegerType()),
    T.StructField("expected_transition_count", T.IntegerType()),
])

BANK = T.StructType([
    T.StructField("database", T.StringType()), T.StructField("table", T.StringType()),
    T.StructField("document_context", T.StringType()),
    T.StructField("templates", T.ArrayType(T.StructType([
        T.StructField("original", T.StringType()), T.StructField("template_pattern", T.StringType()),
        T.StructField("primary_data_fields", T.ArrayType(T.StringType())),
        T.StructField("foreign_data_fields", T.ArrayType(T.StringType())),
        T.StructField("variation_class", T.StringType()),
        T.StructField("variations", T.ArrayType(T.StringType())),
        T.StructField("counter_variations", T.ArrayType(T.StringType())),
        T.StructField("null_variations", T.ArrayType(T.StringType())),
        T.StructField("lexical_sets", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("is_static", T.BooleanType()),
    ]))),
])


def _json(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=multi_line, recursiveFileLookup=True)


def read_sentence_templates(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per sentence: tag, its column, the column's value, modes and ratio."""
    raw = _json(spark, path, SENTENCE_TEMPLATE, multi_line)
    tag = F.regexp_extract("sentence", r"\(Hash:\s*([a-f0-9]+)\)", 1)
    return (raw.select("*", F.posexplode("generated_sentences").alias("pos", "sentence"))
            .withColumn("tag", F.nullif(tag, F.lit("")))
            .withColumn("field", F.try_element_at("hash_to_column", F.col("tag")))
            .withColumn("value", F.try_element_at("original_data", F.col("field")))
            .select("database", "table", "pos", "tag", "field", "value", "sentence",
                    "null_mode", "binary_mode", "data_noise_ratio"))


def read_narratives(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per pipe-delimited segment of a narrative."""
    raw = _json(spark, path, NARRATIVE, multi_line)
    text = F.array_join("narrative", "\n\n")
    segments = F.filter(F.transform(F.split(text, r"\|"), lambda s: F.trim(s)),
                        lambda s: ~s.rlike(r"^\s*$"))
    return (raw.select("database", "table", "data_noise_ratio",
                       F.posexplode(segments).alias("pos", "segment"))
            .withColumn("tag", F.nullif(F.regexp_extract("segment", r"\(Hash:\s*([a-f0-9]+)\)", 1), F.lit(""))))


def read_bank(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Bank rows ``(database, table, tmpl_ix, field, others, variation_class, is_static, lexical_sets, pool, vid, pattern)``.

    ``field`` is the first primary field, ``others`` the further primary and then the foreign ones, in order. Repeated
    wordings of a pool are dropped inside the array, so nothing is shuffled. A template without wordings has one row with
    a NULL pattern. ``bank_from_df`` turns the rows of one table into a bank.
    """
    raw = _json(spark, path, BANK, multi_line)
    t = raw.select("database", "table", F.posexplode("templates").alias("tmpl_ix", "t"))
    pools = F.array(*[F.struct(F.lit(name).alias("pool"), F.array_distinct(F.col(f"t.{col}")).alias("p"))
                      for name, col in (("std", "variations"), ("counter", "counter_variations"),
                                        ("null", "null_variations"))])
    none = F.array(F.struct(F.lit("std").alias("pool"), F.array(F.lit(None).cast("string")).alias("p")))
    worded = F.filter(pools, lambda x: F.coalesce(F.size(x["p"]), F.lit(0)) > 0)
    no_names = F.expr("cast(array() as array<string>)")
    primary = F.coalesce("t.primary_data_fields", no_names)
    field = F.get(primary, F.lit(0))
    named = F.array_distinct(F.concat(primary, F.coalesce("t.foreign_data_fields", no_names)))
    head = ("database", "table", "tmpl_ix", "field", "others", "variation_class", "is_static", "lexical_sets")
    return (t.select("database", "table", "tmpl_ix", field.alias("field"),
                     F.filter(named, lambda f: ~f.eqNullSafe(field)).alias("others"), F.col("t.variation_class").alias("variation_class"),
                     F.coalesce("t.is_static", F.lit(False)).alias("is_static"),
                     F.col("t.lexical_sets").alias("lexical_sets"), F.explode(F.when(F.size(worded) > 0, worded).otherwise(none)).alias("x"))
            .select(*head, F.col("x.pool").alias("pool"), F.posexplode("x.p").alias("vid", "pattern")))


def read_tags(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``(database, table, tag, field, replacement)`` of stored banks: the field a tag stands for and the words that show its value."""
    pairs = T.MapType(T.StringType(), T.StringType())
    schema = T.StructType([*BANK.fields[:2], T.StructField("hash_to_column", pairs), T.StructField("hash_to_replacement", pairs)])
    raw = _json(spark, path, schema, multi_line)
    tags = raw.select("database", "table", "hash_to_replacement", F.explode("hash_to_column").alias("tag", "field"))
    return tags.select("database", "table", "tag", "field", F.try_element_at("hash_to_replacement", F.col("tag")).alias("replacement"))


def read_column_descriptions(spark: SparkSession, path: str) -> DataFrame:
    schema = ("original_column_name string, column_name string, column_description string, "
              "value_description string, data_format string")
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"', encoding="UTF-8")


def join_column_descriptions(columns: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Columns with display name and description; a missing display name is the original name."""
    d = descriptions.select(
        F.lower(F.trim("original_column_name")).alias("_k"),
        F.nullif(F.trim("column_name"), F.lit("")).alias("_display"),
        F.trim("column_description").alias("column_description"),
        F.trim("value_description").alias("value_description"), F.trim("data_format").alias("data_format"))
    return (columns.join(d, F.lower("original_name") == F.col("_k"), "left")
            .withColumn("display_name", F.coalesce("_display", "original_name")).drop("_k", "_display"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with 1-based numbers per file, numbered in parallel.

    A line's number is its place inside its file block plus the lines of earlier
    blocks; only one count per block is gathered.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"), "value")
    blocks = raw.groupBy("file_path", "block").agg(F.count("*").alias("n"), F.min("mid").alias("first"))
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file_path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    return (raw.join(offsets, ["file_path", "block"])
            .select("file_path", (F.col("skip") + F.col("mid") - F.col("first") + 1).alias("line_no"), "value"))


def read_workload(spark: SparkSession, path: str) -> DataFrame:
    """Gold queries ``(line_no, sql, db_id)`` from ``query<TAB>db`` lines; malformed lines are skipped."""
    parts = F.split("value", "\t")
    return (read_lines(spark, path).where((F.trim("value") != "") & (F.size(parts) == 2))
            .select("line_no", F.trim(parts[0]).alias("sql"), F.trim(parts[1]).alias("db_id")))


# --- fixed values: target type of a declared type, first match wins ---------------
TYPE_MAP = [("INT", "bigint"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("BLOB", "binary")]


def mapped_type(declared: str) -> str:
    return next((t for part, t in TYPE_MAP if part in declared.upper()), "string")


def cast_declared(df: DataFrame, declared: dict[str, str]) -> DataFrame:
    """Cast each column to the stored type of its declared type."""
    return df.select(*[F.col(c).cast(mapped_type(declared.get(c, ""))).alias(c) for c in df.columns])
