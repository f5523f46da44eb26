"""Comparing answers with the truth and summing up runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.functions.text import answers_match


def head_tables(tables: dict[str, tuple[DataFrame, str]], n: int | None) -> dict[str, DataFrame]:
    """First n rows by key of every table (``{name: (table, key)}``); all rows without n."""
    return {name: df if n is None else df.orderBy(key).limit(n) for name, (df, key) in tables.items()}


def ground_truth(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of a gold query as answer texts ``(answer)``, one per row; table names are written ``{name}``.

    A query that cannot be analysed has no truth.
    """
    from pyspark.errors import AnalysisException, ParseException
    try:
        rows = spark.sql(sql, **tables)
        return rows.select(F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in rows.columns]).alias("answer"))
    except (AnalysisException, ParseException):
        return spark.createDataFrame([], "answer string")


def as_answer_list(answers: DataFrame) -> DataFrame:
    """Answer rows as one array; meant for answers a reader looks at, not for tables."""
    return answers.agg(F.array_sort(F.collect_list("answer")).alias("answers"))


def score(answers: DataFrame, tolerance: float = 0.01) -> DataFrame:
    return answers.withColumn("correct", answers_match(F.col("extracted"), F.col("ground_truth"), tolerance))


def _summary_columns() -> dict[str, Column]:
    n = F.count(F.lit(1))
    right = F.count_if("correct")
    # seconds and cost are added as decimals, so that the order of rows does not matter
    return {
        "total_questions": n.cast("double"),
        "total_execution_time_seconds": F.round(F.coalesce(F.sum(F.col("seconds").cast("decimal(28,6)")).cast("double"), F.lit(0.0)), 4),
        "total_llm_tokens": F.coalesce(F.sum("tokens"), F.lit(0)).cast("double"),
        "total_llm_cost": F.round(F.coalesce(F.sum(F.col("cost").cast("decimal(28,9)")).cast("double"), F.lit(0.0)), 6),
        "num_correct": right.cast("double"),
        "accuracy": F.coalesce(F.round(F.try_divide(right, n), 4), F.lit(0.0)),
    }


def metrics_summary(metrics: DataFrame, skipped: int = 0) -> DataFrame:
    """``(metric, value)`` rows of a run."""
    columns = {**_summary_columns(), "num_skipped_unsupported": F.lit(float(skipped))}
    one = metrics.agg(*[c.alias(n) for n, c in columns.items()])
    cells = ", ".join(f"'{n}', {n}" for n in columns)
    return one.select(F.expr(f"stack({len(columns)}, {cells}) as (metric, value)"))


def compare_systems(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """The same summary per system, null mode, ratio or number of documents."""
    return metrics.groupBy(*keys).agg(*[c.alias(n) for n, c in _summary_columns().items()])


def accuracy_table(metrics: DataFrame, rows: list[str], systems: list[str]) -> DataFrame:
    """Accuracy per row key with one column per system."""
    right = F.round(F.try_divide(F.count_if("correct"), F.count(F.lit(1))), 4)
    return metrics.groupBy(*rows).pivot("system", systems).agg(right)


# --- fixed values: short names of step types ---------------------------------------
OP_ALIASES = {"filter": "sem_filter", "join": "sem_join", "group": "sem_cluster_by", "agg": "sem_agg",
              "extract": "sem_extract", "topk": "sem_topk"}


def filter_by_ops(questions: DataFrame, steps: DataFrame, ops: list[str], difficulties: list[str] | None = None,
                  databases: list[str] | None = None) -> DataFrame:
    """Questions that use one of the step types, of the wanted difficulty and database."""
    wanted = [OP_ALIASES.get(o, o) for o in ops]
    used = steps.where(F.col("op_type").isin(wanted)).select("question_id")
    out = questions.join(used, "question_id", "left_semi")
    if difficulties is not None:
        out = out.where(F.col("difficulty").isin(difficulties))
    return out if databases is None else out.where(F.col("db_id").isin(databases))


def merge_questions(questions: DataFrame, plans: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Questions with the plan of their line and the second SQL dialect of their id; a failed plan stays NULL."""
    return (questions.join(plans.select("line_no", "semantic"), "line_no", "left")
            .join(alternatives.select("question_id", "sql_sqlite"), "question_id", "left"))


def content_hash(df: DataFrame, columns: list[str]) -> Column:
    """Order-free ``rows:sum of hashes`` of a table as an aggregate column; repeated rows and NULL count."""
    cells = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    row = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *cells), 256), 1, 15), 16, 10)
    total = F.coalesce(F.sum(row.cast("decimal(20,0)")), F.lit(0))
    return F.concat_ws(":", F.count(F.lit(1)).cast("string"), total.cast("string"))


def cache_complete(cache: DataFrame, questions: DataFrame, cached_version: int, version: int) -> DataFrame:
    """One row: whether a stored workload has the right version, size and ids."""
    pair = cache.select("question_id", F.lit(1).alias("_c")).join(
        questions.select("question_id", F.lit(1).alias("_q")), "question_id", "full")
    return pair.agg(F.count_if(F.col("_c").isNull()).alias("missing"), F.count_if(F.col("_q").isNull()).alias("extra")).select(
        "missing", "extra", ((F.col("missing") == 0) & (F.col("extra") == 0) & F.lit(cached_version == version)).alias("complete"))


def op_histogram(steps: DataFrame) -> DataFrame:
    """Step counts by class and type."""
    kind = (F.when(F.col("op_type").contains("scan"), "scan").when(F.col("op_type").contains("join"), "join")
            .when(F.col("op_type").isin("sem_agg", "sem_cluster_by"), "aggregate")
            .when(F.col("op_type").isin("sem_topk", "sort"), "sort").otherwise("other"))
    return steps.groupBy(kind.alias("op_class"), "op_type").agg(F.count("*").alias("n"))


def op_token_catalog(formats: DataFrame, column: str = "format") -> DataFrame:
    """Distinct post-operators written in stored formats as ``OP: name``."""
    pattern = (r"OP:\s*(.+?)(?=\s*&&|\s*\||\s*/\s|\s*\"|,\s*(?:FILTER|EXTRACT|JOIN|GROUP|RANK|AGGREGATE|OP)\b|\s*$)")
    found = F.explode(F.regexp_extract_all(column, F.lit(pattern), F.lit(1)))
    return (formats.select(found.alias("token")).select(F.trim("token").alias("token"))
            .where("token <> ''").distinct())


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
