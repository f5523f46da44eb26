"""Queries over column profiling (PRO)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake import vocab
from textlake.operators import profile as P
from textlake.plans import ducksql as D
from textlake.plans.base import query, table
from textlake.plans.fixtures import LONG_CTE, profile_rows

_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
           "embeddings", "pages", "benchmark", "labels", "conversations"]


@query("pro_1_row_counts", " union all ".join(f"select '{t}' as table_name, count(*) as n from {t}" for t in _TABLES))
def _(spark, sf):
    return P.row_counts({t: table(spark, sf, t) for t in _TABLES})


@query("pro_2_unpivot_rows", f"{LONG_CTE} select row_id, cast(ordinal as integer) as ordinal, field, value from l")
def _(spark, sf):
    return P.unpivot_rows(profile_rows(spark, sf), "row_id")


_MISC = "".join("\\" + c if ord(c) < 128 else c for c in vocab.MISC_CHARACTERS).replace("'", "''")
_FILLED = "upper(trim(coalesce(value, ''))) not in ('NULL', 'NONE', '')"


def _all(test: str) -> str:
    return f"coalesce(bool_and({test}) filter (where {_FILLED}), true)"


CLASS_SQL = f"""case when bool_or(not ({_FILLED})) and bool_or({_FILLED}) and {_all("trim(value) in ('0', '1')")} then 'NULLABLE_BINARY'
 when bool_or(not ({_FILLED})) then 'NULL' when {_all(rf"regexp_matches(value, '^[{_MISC}\s]+$')")} then 'MISC'
 when {_all("trim(value) in ('0', '1')")} then 'BINARY' else 'STANDARD' end"""
TYPE_SQL = f"""case when not bool_or({_FILLED}) then 'null'
 when {_all(f"lower(trim(value)) in ({D.words(vocab.BOOL_WORDS_PROFILE)})")} then 'bool'
 when {_all(r"regexp_matches(regexp_replace(value, '[, ]', '', 'g'), '^[+-]?\d+$')")} then 'int'
 when {_all(rf"regexp_matches(regexp_replace(value, '[, $%]', '', 'g'), '{vocab.NUMBER}')")} then 'float'
 when {_all(f"regexp_matches(trim(value), '{vocab.DATE_WHOLE}')")} then 'date'
 when {_all(f"regexp_matches(trim(value), '{vocab.EMAIL}')")} then 'email'
 when {_all("regexp_matches(trim(value), '^https?://')")} then 'url' else 'string' end"""


@query("pro_3_field_class", f"{LONG_CTE} select field, {CLASS_SQL} as field_class, count(*) as n_rows from l group by field")
def _(spark, sf):
    return P.profile_columns(profile_rows(spark, sf), "row_id").select("field", "field_class", "n_rows")


_KV_CTE = """with l as (select event_type || '_' || k as field, value from (select event_type, 'props' as k, props as value from events
 union all select event_type, 'value', cast(value as varchar) from events
 union all select event_type, 'flag', case when user_id % 2 = 0 then 'Y' else 'no' end from events
 union all select event_type, 'price', '$' || cast(value as varchar) from events
 union all select event_type, 'day', strftime(ts, '%Y-%m-%d') from events))"""


@query("pro_4_data_type", f"{_KV_CTE} select field, {TYPE_SQL} as data_type from l group by field")
def _(spark, sf):
    cells = table(spark, sf, "events").select("event_type", F.expr("""inline(array(
        struct('props' as k, props as value), struct('value' as k, format_number(value, '0.0##############') as value),
        struct('flag' as k, case when user_id % 2 = 0 then 'Y' else 'no' end as value),
        struct('price' as k, '$' || format_number(value, '0.0##############') as value),
        struct('day' as k, date_format(ts, 'yyyy-MM-dd') as value)))"""))
    long = cells.select(F.concat("event_type", F.lit("_"), "k").alias("field"), "value")
    return P.profile_long(long, ["field"]).select("field", "data_type")


@query("pro_4_column_types", f"{LONG_CTE} select field, {TYPE_SQL} as data_type from l group by field")
def _(spark, sf):
    return P.profile_columns(profile_rows(spark, sf), "row_id").select("field", "data_type")


@query("pro_5_row_field_class", rf"""{LONG_CTE} select row_id, field, case when not ({_FILLED}) then 'NULL'
 when regexp_matches(trim(value), '^[{_MISC}\s]+$') then 'MISC' when field like '%(Y/N)%' or (value in ('0', '1') and not
 regexp_matches(lower(field), '{"|".join(vocab.ID_LIKE_KEYWORDS)}')) then 'BINARY' else 'STANDARD' end as row_class from
 (select row_id, case field when 'label' then 'label (Y/N)' else field end as field, value from l)""")
def _(spark, sf):
    long = P.unpivot_rows(profile_rows(spark, sf).withColumnRenamed("label", "label (Y/N)"), "row_id")
    return long.select("row_id", "field", P.row_field_class(F.col("field"), F.col("value")).alias("row_class"))


def _marks(v: str, items: list[str]) -> str:
    return "(" + " + ".join(f"contains({v}, {D.q(m)})::int" for m in items) + ")"


_COMPLEX_SQL = rf"""coalesce(length(v) >= 10 and ({_marks('v', P.DICT_MARKS)} >= 3 or {_marks('v', P.LIST_MARKS)} >= 2
 or {_marks('v', P.NESTED_MARKS)} >= 4 or (v like '{{%' and contains(v, ':') and
 list_max(list_transform(range(1, length(b) + 1), lambda i: 2 * length(replace(b[1:i], '}}', '')) - length(b[1:i]))) > 1)
 or (v like '[%' and contains(v, '{{'))), false)"""
_NESTED = """select event_id, case event_id % 4 when 0 then props when 1 then '{"id": ' || cast(event_id as {string}) || ', "p": ' || props || '}'
 when 2 then '[' || props || ', ' || props || ']' else event_type || ': {' || cast(user_id as {string}) || '} and {x}' end as v from {events}"""


@query("pro_6_is_complex", f"""select event_id, {_COMPLEX_SQL} as is_complex from (select event_id, trim(v) as v,
 regexp_replace(v, '[^{{}}]', '', 'g') as b from ({_NESTED.replace("{string}", "varchar").replace("{events}", "events")}))""")
def _(spark, sf):
    v = spark.sql(_NESTED.replace("{string}", "string").replace("{events}", "{e}").replace("'{\"id", "'{{\"id")
                  .replace("|| '}'", "|| '}}'").replace(": {' ||", ": {{' ||").replace("'} and {x}'", "'}} and {{x}}'"),
                  e=table(spark, sf, "events"))
    return v.select("event_id", P.is_complex(F.col("v")).alias("is_complex"))


@query("pro_6_complex_columns", f"""select 'event_type' as field, 0::bigint as n_complex from events group by 1 union all
 select 'props', count(*) filter (where {_COMPLEX_SQL}) from (select trim(v) as v, regexp_replace(v, '[^{{}}]', '', 'g') as b from
 (select '{{"id": 1, "p": ' || props || '}}' as v from events))""")
def _(spark, sf):
    wrapped = F.concat(F.lit('{"id": 1, "p": '), "props", F.lit("}"))
    return P.complex_columns(table(spark, sf, "events").select("event_type", wrapped.alias("props")))


@query("pro_7_is_misc", rf"""select p_partkey, regexp_matches(v, '^[{_MISC}\s]+$') and trim(v) <> '' as is_misc from
 (select p_partkey, case p_partkey % 5 when 0 then '-- ' when 1 then '…•' when 2 then p_name when 3 then '  ' else '#' || p_brand end as v from part)""")
def _(spark, sf):
    v = F.expr("case p_partkey % 5 when 0 then '-- ' when 1 then '…•' when 2 then p_name when 3 then '  ' else '#' || p_brand end")
    return table(spark, sf, "part").select("p_partkey", P.T.is_misc(v).alias("is_misc"))


@query("pro_8_is_date", rf"""select o_orderkey, regexp_matches(trim(v), '{vocab.DATE_STARTS}') as is_date from (select o_orderkey,
 case o_orderkey % 6 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%m/%d/%Y') when 2 then strftime(o_orderdate, '%d-%b-%Y')
 when 3 then ' ' || strftime(o_orderdate, '%b %d, %Y') when 4 then o_orderpriority else strftime(o_orderdate, '%Y%m') end as v from orders)""")
def _(spark, sf):
    v = F.expr("""case o_orderkey % 6 when 0 then date_format(o_orderdate, 'yyyy-MM-dd') when 1 then date_format(o_orderdate, 'MM/dd/yyyy')
      when 2 then date_format(o_orderdate, 'dd-MMM-yyyy') when 3 then ' ' || date_format(o_orderdate, 'MMM dd, yyyy')
      when 4 then o_orderpriority else date_format(o_orderdate, 'yyyyMM') end""")
    return table(spark, sf, "orders").select("o_orderkey", P.T.is_date(v).alias("is_date"))


@query("pro_9_natural_names", """select event_id, trim(replace(replace(f, '(Y/N)', ''), '(T/F)', '')) as natural_name,
 f like '%(_/_)%' or v in ('0', '1') as is_binary from (select event_id, event_type || case event_id % 3 when 0 then ' (Y/N)'
 when 1 then ' (T/F)' else '' end as f, cast(user_id % 4 as varchar) as v from events)""")
def _(spark, sf):
    f = F.expr("event_type || case event_id % 3 when 0 then ' (Y/N)' when 1 then ' (T/F)' else '' end")
    return table(spark, sf, "events").select(
        "event_id", P.natural_name(f).alias("natural_name"),
        P.is_binary_field(f, (F.col("user_id") % 4).cast("string")).alias("is_binary"))


@query("pro_10_first_non_null", f"""{LONG_CTE} select field, coalesce(arg_min(value, row_id) filter (where {_FILLED}), 'Sample_' || field) as value
 from (select row_id, field, value from l union all select row_id, 'never', null from p) group by field""")
def _(spark, sf):
    rows = profile_rows(spark, sf).withColumn("never", F.lit(None).cast("string"))
    return P.first_non_null(P.unpivot_rows(rows, "row_id"))


def _score(words: list[str]) -> str:
    return " + ".join(f"cast((length(t) - length(replace(t, '{w}', ''))) / {len(w)} as int)" for w in words)


_DOMAIN_FIELDS = ["data_source", "n_chars"]
_BONUS = {d: sum(w in n for w in ws for n in _DOMAIN_FIELDS) for d, ws in P.DOMAIN_KEYWORDS.items()}
_MIXED = """lower(text) || case page_id % 4 when 0 then ' school account bank' when 1 then ' production quality product' when 2 then ' clinic doctor data data' else '' end"""
_SCORES = ", ".join(f"{{'s': {_score(ws)} + {_BONUS[d]}, 'r': {-i}, 'd': '{d}'}}"
                    for i, (d, ws) in enumerate(P.DOMAIN_KEYWORDS.items()))


@query("pro_11_document_domain", f"""select doc_id, case when b.s > 0 then b.d else 'professional' end || ' data report' as domain from
 (select doc_id, list_max([{_SCORES}]) as b from (select doc_id, {_MIXED.replace('page_id', 'doc_id')} as t from documents))""")
def _(spark, sf):
    text = F.expr(_MIXED.replace("page_id", "doc_id"))
    return (table(spark, sf, "documents", heavy=True).select("doc_id", text.alias("t"))
            .select("doc_id", P.document_domain(F.col("t"), _DOMAIN_FIELDS).alias("domain")))


@query("pro_12_describe_columns", """select 'part' as table_name, 'c' || cast(p_partkey as varchar) as column_name,
 case when p_partkey % 4 = 0 then p_name when p_partkey % 3 = 0 then p_type else 'Data field representing c' || cast(p_partkey as varchar) || ' information.' end as descriptor,
 case when p_partkey % 4 = 0 then 'enhanced' when p_partkey % 3 = 0 then 'base' else 'fallback' end as origin from part""")
def _(spark, sf):
    part = table(spark, sf, "part").select(
        "*", F.lit("part").alias("table_name"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("column_name"))
    enhanced = part.select("table_name", "column_name", F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(" ").alias("descriptor"))
    base = part.where(F.col("p_partkey") % 3 == 0).select("table_name", "column_name", F.col("p_type").alias("descriptor"))
    return P.describe_columns(part.select("table_name", "column_name"), enhanced, base)


_FIRST_WORD = r"lower(regexp_extract(text, '([\p{L}\p{N}_]+)', 1))"


@query("pro_13_common_word_values", f"""with v as (select item_id, {_FIRST_WORD} as value from benchmark),
 w as (select doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '[\\s\\p{{Z}}]+'),
 lambda w: length(w) > 2))) as word from documents), n as (select word, count(*) as n_docs from w group by word)
 select item_id, value, coalesce(n_docs, 0) as n_docs, coalesce(n_docs, 0) >= 0.2 * (select count(*) from documents) as is_common from v left join n on word = value""")
def _(spark, sf):
    values = table(spark, sf, "benchmark").select(
        "item_id", F.lower(F.regexp_extract("text", r"([\p{L}\p{N}_]+)", 1)).alias("value"))
    return P.common_word_values(values, table(spark, sf, "documents", heavy=True), "text", 0.2)
