"""Views over the given tables that both engines build from the same SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textlake.plans.base import view

PROFILE_ROWS = """select p_partkey as row_id, p_name as label, cast(p_size as {string}) as size_no,
 case when p_partkey % 2 = 0 then '1' else '0' end as is_even,
 case when p_partkey % 5 = 0 then null when p_partkey % 2 = 0 then '1' else '0' end as is_promo,
 case when p_partkey % 7 = 0 then null else p_brand end as brand,
 case when p_partkey % 3 = 0 then '-' else '+' end as marker,
 concat('user', cast(p_partkey as {string}), '@example.com') as contact,
 concat('https://example.com/p/', cast(p_partkey as {string})) as link,
 concat('2024-01-', lpad(cast(1 + p_partkey % 28 as {string}), 2, '0')) as seen_on
 from {part}"""
PROFILE_FIELDS = ["label", "size_no", "is_even", "is_promo", "brand", "marker", "contact", "link", "seen_on"]

CUSTOMER_X = """select c_custkey, c_name, c_nationkey, c_mktsegment, c_acctbal,
 case when c_acctbal < 0 then 1 else 0 end as is_debtor,
 case when c_custkey % 6 = 0 then null else c_mktsegment end as channel,
 case when c_custkey % 9 = 0 then null when c_custkey % 2 = 0 then 1 else 0 end as opted_in
 from {customer}"""

CALL_LOG = """select conv_id, turn, concat('m', cast(conv_id % 3 as {string})) as model, role,
 case when role = 'assistant' then 0 else cast(floor(length(text) / 4.0) as bigint) end as input_tokens,
 case when role = 'assistant' then cast(floor(length(text) / 4.0) as bigint) else 0 end as output_tokens
 from {conversations}"""


def duck(sql: str) -> str:
    """Fixture text for the comparison engine."""
    for name in ("part", "customer", "conversations", "orders", "documents", "events", "lineitem"):
        sql = sql.replace("{" + name + "}", name)
    return sql.replace("{string}", "varchar")


def spark_view(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    return view(spark, sf_dir, sql.replace("{string}", "string"), *names, heavy=True)


def profile_rows(spark, sf_dir):
    return spark_view(spark, sf_dir, PROFILE_ROWS, "part")


def customer_x(spark, sf_dir):
    return spark_view(spark, sf_dir, CUSTOMER_X, "customer")


def call_log(spark, sf_dir):
    return spark_view(spark, sf_dir, CALL_LOG, "conversations")


# long form of profile_rows for the comparison engine
LONG_SQL = " union all ".join(
    f"select row_id, {i + 1} as ordinal, '{f}' as field, {f} as value from p" for i, f in enumerate(PROFILE_FIELDS))
LONG_CTE = f"with p as ({duck(PROFILE_ROWS)}), l as ({LONG_SQL})"
