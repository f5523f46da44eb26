"""Token and cost accounting over call logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions.sums import exact_sum

# --- fixed values: USD per million tokens, input and output --------------------------
PRICES = {"gpt-4o": (5.00, 15.00), "gpt-4o-mini": (0.15, 0.60), "local-llm": (0.0, 0.0)}

# --- fixed values: mean tokens (input, output) and model of a stage ------------------
STAGE_TOKENS = {
    "descriptors": ("gpt-4o-mini", 800, 150),
    "db_contexts": ("gpt-4o", 1500, 200),
    "table_contexts": ("gpt-4o", 1200, 150),
    "templates": ("gpt-4o", 2000, 1000),
    "sentence_variations": ("local-llm", 1500, 800),
    "enhancements": ("gpt-4o", 1500, 500),
    "structural_variations": ("local-llm", 1500, 1200),
    "lexical_filter": ("local-llm", 600, 100),
    "field_detection": ("local-llm", 800, 50),
    "value_replacement": ("local-llm", 1000, 300),
    "counter_refinement": ("local-llm", 500, 300),
}
SENTENCES_PER_TABLE, BINARY_NULL_PER_TABLE, WORDS_PER_SENTENCE, FIELDS_PER_SENTENCE, WORDINGS = 12, 3, 6, 2, 15

# --- fixed values: counted operations -------------------------------------------------
OPERATIONS = ["field_detection", "field_verification", "value_replacement", "counter_refinement", "date_extraction",
              "null_extraction", "binary_extraction", "misc_extraction", "complex_list_extraction",
              "structural_variation", "lexical_filter", "sentence_generation", "common_language_field"]


def model_name(c: Column) -> Column:
    low = F.lower(c)
    return (F.when(low.contains("gpt-4o-mini") | low.contains("gpt4o-mini"), "gpt-4o-mini")
            .when(low.contains("gpt-4o") | low.contains("gpt4o"), "gpt-4o").otherwise("local-llm"))


def _price(model: Column, side: int) -> Column:
    chain = F.when(F.lit(False), F.lit(0.0))
    for name, prices in PRICES.items():
        chain = chain.when(model == name, F.lit(prices[side]))
    return chain.otherwise(F.lit(0.0))


def cost_of(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in / 1_000_000 * _price(model, 0) + tokens_out / 1_000_000 * _price(model, 1)


def usage_by_model(calls: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Tokens and calls per model (and further keys)."""
    return (calls.withColumn("model", model_name(F.col("model"))).groupBy(*(keys or []), "model")
            .agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
                 F.count("*").alias("call_count")))


def with_cost(usage: DataFrame) -> DataFrame:
    return usage.withColumn("cost", cost_of(F.col("model"), F.col("input_tokens"), F.col("output_tokens")))


def calls_by_operation(calls: DataFrame, column: str = "operation") -> DataFrame:
    """Calls per known operation."""
    return (calls.where(F.col(column).isin(OPERATIONS)).groupBy(F.col(column).alias("operation"))
            .agg(F.count("*").alias("n")))


def savings(skipped: DataFrame, actual_cost: Column | None = None) -> DataFrame:
    """Cost that cached items would have had: ``skipped`` is (kind, n)."""
    kind = F.when(F.col("kind") == "reused_descriptors", "descriptors").otherwise(F.col("kind"))
    chain = F.when(F.lit(False), F.lit(0.0))
    for name, (model, tin, tout) in STAGE_TOKENS.items():
        chain = chain.when(kind == name, cost_of(F.lit(model), F.col("n") * tin, F.col("n") * tout))
    return skipped.withColumn("saved", chain.otherwise(F.lit(0.0)))


def savings_total(skipped: DataFrame, actual: float) -> DataFrame:
    """Total saved and its share of what everything would have cost."""
    total = savings(skipped).agg(F.sum(F.col("saved").cast("decimal(28,9)")).cast("double").alias("saved"))
    return total.select("saved", F.lit(actual).alias("actual"),
                        F.coalesce(F.try_divide(F.col("saved"), F.col("saved") + actual) * 100, F.lit(0.0)).alias("percent"))


def full_run_estimate(sizes: DataFrame) -> DataFrame:
    """Calls, tokens and cost per stage of a full run, for each row of (…, n_tables, n_columns)."""
    t, c = F.col("n_tables"), F.col("n_columns")
    sentences = t * SENTENCES_PER_TABLE
    special = t * BINARY_NULL_PER_TABLE
    calls = {
        "descriptors": t * c,
        "db_contexts": F.least(F.floor(t / 10), F.lit(50)),
        "table_contexts": t,
        "templates": t,
        "structural_variations": sentences + special,
        "lexical_filter": sentences * WORDS_PER_SENTENCE,
        "field_detection": sentences * FIELDS_PER_SENTENCE * WORDINGS,
        "value_replacement": F.floor(sentences * WORDINGS / 5),
        "counter_refinement": special * WORDINGS,
    }
    rows = F.array(*[F.struct(
        F.lit(stage).alias("stage"), F.lit(STAGE_TOKENS[stage][0]).alias("model"), n.cast("bigint").alias("calls"),
        (n * STAGE_TOKENS[stage][1]).cast("bigint").alias("input_tokens"),
        (n * STAGE_TOKENS[stage][2]).cast("bigint").alias("output_tokens")) for stage, n in calls.items()])
    keys = [k for k in sizes.columns if k not in ("n_tables", "n_columns")]
    return with_cost(sizes.select(*keys, F.inline(rows)))


def cost_report(calls: DataFrame) -> DataFrame:
    """Usage and cost per model with a ``total`` row, and the time between first and last call."""
    usage = with_cost(usage_by_model(calls))
    span = calls.agg(F.max("ts").alias("b"), F.min("ts").alias("a")).select(
        (F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))).alias("d"))
    # a handful of model rows: the roll-up adds the total
    rolled = usage.rollup("model").agg(
        F.sum("call_count").alias("call_count"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost"), 9).alias("cost"))
    return rolled.select(F.coalesce("model", F.lit("total")).alias("model"), "call_count", "input_tokens", "output_tokens",
                         "cost", (span.scalar() / 1_000_000).alias("duration_seconds"))


def op_cost_dedup(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Time, cost and tokens with every operator counted once across paths."""
    once = stats.groupBy(*keys, "op_id").agg(F.min(F.struct("path", "seconds", "cost", "tokens")).alias("f"))
    return once.groupBy(*keys).agg(
        F.count("*").alias("n_ops"), exact_sum(F.col("f.seconds")).alias("seconds"),
        exact_sum(F.col("f.cost")).alias("cost"), F.sum("f.tokens").alias("tokens"))
