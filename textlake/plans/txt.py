"""Queries over the scalar text functions (TXT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake import vocab
from textlake.functions import text as T
from textlake.plans import ducksql as D
from textlake.plans.base import query, table

_SHOPPED = """select doc_id, case doc_id % 4 when 0 then 'See <b>' || text || '</b>' when 1 then '"' || text || '"'
 when 2 then 'a\\b/' || text else text end as t from documents"""


def _marked(spark, sf):
    return table(spark, sf, "documents", heavy=True).select("doc_id", F.expr(
        r"""case doc_id % 4 when 0 then 'See <b>' || text || '</b>' when 1 then '"' || text || '"'
            when 2 then 'a\\b/' || text else text end""").alias("t"))


@query("txt_1_clean_field_string",
       f"select doc_id, md5({D.clean_field_string('t')}) as cleaned from ({_SHOPPED})")
def _(spark, sf):
    return _marked(spark, sf).select("doc_id", F.md5(T.clean_field_string(F.col("t"))).alias("cleaned"))


_ANSWERED = """select conv_id, turn, case turn % 3 when 0 then '"**' || text || '**"'
 when 1 then 'Use `' || role || '` then ```code``` ' || text else text end as t from conversations"""


def _answered(spark, sf):
    return table(spark, sf, "conversations", heavy=True).select("conv_id", "turn", F.expr(
        """case turn % 3 when 0 then '"**' || text || '**"'
           when 1 then 'Use `' || role || '` then ```code``` ' || text else text end""").alias("t"))


@query("txt_2_clean_model_response", f"""select conv_id, turn, md5({D.squeeze(
    "regexp_replace(regexp_replace(replace(regexp_replace(trim(t), '^[\"''`]+|[\"''`]+$', '', 'g'), '*', ''), "
    "'```[^`]*```', '', 'g'), '`([^`]*)`', '\\1', 'g')")}) as cleaned from ({_ANSWERED})""")
def _(spark, sf):
    return _answered(spark, sf).select("conv_id", "turn",
                                       F.md5(T.clean_model_response(F.col("t"))).alias("cleaned"))


_HOLES = """select page_id, html || case page_id % 3 when 0 then ' [URL] is [P_NAME].' when 1 then ' []' else ' [A B' end
 as t from pages"""


@query("txt_3_count_placeholders", rf"""select page_id,
 cast(len(regexp_extract_all(t, '\[[^\]]+\]')) as integer) as holes from ({_HOLES})""")
def _(spark, sf):
    t = table(spark, sf, "pages", heavy=True).select("page_id", F.expr(
        """html || case page_id % 3 when 0 then ' [URL] is [P_NAME].' when 1 then ' []'
           else ' [A B' end""").alias("t"))
    return t.select("page_id", T.count_placeholders(F.col("t")).alias("holes"))


@query("txt_4_strip_tags", f"""select doc_id, md5({D.strip_tags(
    "'| ' || text || ' (Hash: ' || substr(md5(text), 1, 16) || ') |'")}) as plain from documents""")
def _(spark, sf):
    tagged = F.concat(F.lit("| "), F.col("text"), F.lit(" (Hash: "),
                      F.substring(F.md5("text"), 1, 16), F.lit(") |"))
    return table(spark, sf, "documents", heavy=True).select("doc_id", F.md5(T.strip_tags(tagged)).alias("plain"))


_VALUE = """case (l_orderkey + l_linenumber) % 6 when 0 then cast(cast(l_quantity as int) as varchar)
 when 1 then printf('%.2f', l_extendedprice) when 2 then printf('%.4f', l_discount) when 3 then l_returnflag
 when 4 then '00' || cast(l_partkey as varchar) else case when l_partkey % 2 = 0 then 'NULL' else 'inf' end end"""


def _values(spark, sf):
    return table(spark, sf, "lineitem", heavy=True).select("l_orderkey", "l_linenumber", "l_partkey", F.expr(
        """case (l_orderkey + l_linenumber) % 6 when 0 then cast(cast(l_quantity as int) as string)
           when 1 then format_number(l_extendedprice, '0.00') when 2 then format_number(l_discount, '0.0000')
           when 3 then l_returnflag when 4 then '00' || cast(l_partkey as string)
           else case when l_partkey % 2 = 0 then 'NULL' else 'inf' end end""").alias("v"))


@query("txt_5_format_value", f"""select l_orderkey, l_linenumber, l_partkey, {D.format_value('amount', 'v')} as plain,
 {D.format_value('percent_off', 'v')} as shown, {D.format_value('percent_off', 'v', 'raw')} as raw,
 {D.format_value('percent_off', 'v', 'sentence')} as sentence
 from (select l_orderkey, l_linenumber, l_partkey, {_VALUE} as v from lineitem)""")
def _(spark, sf):
    v = F.col("v")
    return _values(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", T.format_value("amount", v).alias("plain"),
        T.format_value("percent_off", v).alias("shown"),
        T.format_value("percent_off", v, "raw").alias("raw"),
        T.format_value("percent_off", v, "sentence").alias("sentence"))


def _column_value(mode: str) -> str:
    missing = "NULL" if mode == "explicit" else "not specified"
    return (f"case when upper(v) in ({D.words(vocab.NULL_WORDS_SENTENCE)}) then '{missing}' "
            f"when v like '0%' and v not like '%.%' then v else {D.format_value('amount', 'v', 'sentence')} end")


@query("txt_6_format_column_value", f"""select l_orderkey, l_linenumber, l_partkey,
 {_column_value('explicit')} as explicit_text, {_column_value('implicit')} as implicit_text
 from (select l_orderkey, l_linenumber, l_partkey, {_VALUE} as v from lineitem)""")
def _(spark, sf):
    v = F.col("v")
    return _values(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey",
        T.format_column_value("amount", v, "explicit").alias("explicit_text"),
        T.format_column_value("amount", v, "implicit").alias("implicit_text"))


@query("txt_7_humanize_column", f"""select event_id, {D.humanize_column(
    "'t' || cast(event_id % 3 as varchar) || '.' || event_type || '_by_' || cast(user_id as varchar)")} as name
 from events""")
def _(spark, sf):
    ref = F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string"), F.lit("."), F.col("event_type"),
                   F.lit("_by_"), F.col("user_id").cast("string"))
    return table(spark, sf, "events").select("event_id", T.humanize_column(ref).alias("name"))


_DATED = """select o_orderkey, case o_orderkey % 5 when 0 then strftime(o_orderdate, '%Y%m')
 when 1 then strftime(o_orderdate, '%Y-%m-%d') when 2 then strftime(o_orderdate, '%Y-%m-')
 when 3 then strftime(o_orderdate, '%Y-%m') else o_orderpriority end as d from orders"""


def _dated(spark, sf):
    return table(spark, sf, "orders").select("*", F.expr(
        """case o_orderkey % 5 when 0 then date_format(o_orderdate, 'yyyyMM')
           when 1 then date_format(o_orderdate, 'yyyy-MM-dd') when 2 then date_format(o_orderdate, 'yyyy-MM-')
           when 3 then date_format(o_orderdate, 'yyyy-MM') else o_orderpriority end""").alias("d"))


@query("txt_8_humanize_date", f"select o_orderkey, {D.humanize_date('d')} as spoken from ({_DATED})")
def _(spark, sf):
    return _dated(spark, sf).select("o_orderkey", T.humanize_date(F.col("d")).alias("spoken"))


def _like_sql(col: str, p: str, negate: str) -> str:
    subject = f"'The ' || {D.humanize_column(col)} || ' '"
    head = f"regexp_replace({p}, '%+$', '')"
    return f"""(case when {p} like '\\%%' escape '\\' and {p} like '%\\%' escape '\\' then {subject} ||
 case when {negate} then 'does not mention ' else 'mentions ' end || {D.humanize_date(f"trim({p}, '%')")}
 when {p} like '%\\%' escape '\\' and {D.humanize_date(head)} <> {head} then {subject} ||
 case when {negate} then 'is not in ' else 'is in ' end || {D.humanize_date(head)}
 when {p} like '%\\%' escape '\\' then {subject} || 'starts with ' || {head}
 when {p} like '\\%%' escape '\\' then {subject} || 'ends with ' || {D.humanize_date(f"ltrim({p}, '%')")}
 else {subject} || case when {negate} then 'is not like ' else 'is like ' end || {D.humanize_date(p)} end)"""


_PATTERNED = f"""select o_orderkey, case o_orderkey % 7 when 0 then '%' || o_orderpriority || '%' when 1 then o_orderpriority || '%'
 when 2 then '%' || o_orderstatus when 3 then o_orderpriority else d || '%' end as p from ({_DATED}) join
 orders using (o_orderkey)"""


@query("txt_9_like_text", f"""select o_orderkey, {_like_sql("'t1.order_date'", 'p', 'o_orderkey % 2 = 0')} as words
 from ({_PATTERNED})""")
def _(spark, sf):
    p = F.expr("""case o_orderkey % 7 when 0 then '%' || o_orderpriority || '%' when 1 then o_orderpriority || '%'
                  when 2 then '%' || o_orderstatus when 3 then o_orderpriority else d || '%' end""")
    return _dated(spark, sf).select("o_orderkey", T.like_text(
        F.lit("t1.order_date"), p, F.col("o_orderkey") % 2 == 0).alias("words"))


_OPS = ["IS NULL", "IS NOT NULL", "BETWEEN", "NOT BETWEEN", "LIKE", "NOT LIKE", "IN", "NOT IN",
        ">=", "<=", "<>", "!=", ">", "<", "="]
_PREDICATES = f"""select l_orderkey, l_linenumber, l_partkey, [{D.words(_OPS)}][1 + (l_orderkey + l_partkey) % {len(_OPS)}] as op,
 case l_linenumber % 3 when 0 then 'l.l_shipdate' when 1 then 'l_quantity' else 't2.unit_price' end as col,
 strftime(l_shipdate, '%Y-%m-%d') as v1, strftime(l_shipdate, '%Y%m') as v2 from lineitem"""


def predicates(spark, sf):
    """One structured predicate per line item."""
    pick = (F.lit(1) + (F.col("l_orderkey") + F.col("l_partkey")) % len(_OPS)).cast("int")
    return table(spark, sf, "lineitem", heavy=True).select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.element_at(F.array(*[F.lit(o) for o in _OPS]), pick).alias("op"),
        F.expr("case l_linenumber % 3 when 0 then 'l.l_shipdate' when 1 then 'l_quantity' else 't2.unit_price' end")
        .alias("col"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("v1"), F.date_format("l_shipdate", "yyyyMM").alias("v2"))


def _predicate_sql() -> str:
    subject = f"'The ' || {D.humanize_column('col')} || ' '"
    d1, d2 = D.humanize_date("v1"), D.humanize_date("v2")
    cases = [("IS NOT NULL", "'has a value'"), ("IS NULL", "'is absent'"),
             ("NOT BETWEEN", f"'is not between ' || {d1} || ' and ' || {d2}"),
             ("BETWEEN", f"'is between ' || {d1} || ' and ' || {d2}"),
             ("NOT IN", "'is not in (' || v1 || ')'"), ("IN", "'is in (' || v1 || ')'")]
    cases += [(k, f"'{w} ' || {d1}") for k, w in T.COMPARISON_TEXT.items()]
    whens = " ".join(f"when op = '{k}' then {subject} || {w}" for k, w in cases)
    return f"(case when op in ('LIKE', 'NOT LIKE') then {_like_sql('col', 'v1', chr(39) + 'NOT LIKE' + chr(39) + ' = op')} {whens} end)"


@query("txt_10_predicate_text", f"""select l_orderkey, l_linenumber, l_partkey, {_predicate_sql()} || ' and The l quantity is greater than ' || cast(l_linenumber as varchar) as words
 from ({_PREDICATES})""")
def _(spark, sf):
    p = predicates(spark, sf)
    first = T.predicate_text(F.col("op"), F.col("col"), F.col("v1"), F.col("v2"))
    second = T.predicate_text(F.lit(">"), F.lit("l.l_quantity"), F.col("l_linenumber").cast("string"), F.lit(None))
    return p.select("l_orderkey", "l_linenumber", "l_partkey", F.concat_ws(" and ", first, second).alias("words"))


_STEP_TYPES = ["sem_filter", "sem_join", "sem_cluster_by", "sem_agg", "sem_extract", "sem_topk"]
STEPS_SQL = f"""select l_orderkey as question_id, l_linenumber as op_index, l_partkey as tie,
 [{D.words(_STEP_TYPES)}][1 + (l_orderkey + l_partkey) % 6] as op_type,
 case l_suppkey % 3 when 0 then 't1.unit_price' when 1 then 'order_date' else 'T2.customer_id' end as col,
 case l_partkey % 4 when 0 then '=' when 1 then '>=' when 2 then 'LIKE' else 'NOT IN' end as op,
 l_returnflag as v1, case l_suppkey % 3 when 0 then 'COUNT' when 1 then 'SUM' else 'MAX' end as func,
 cast(1 + l_partkey % 3 as integer) as k, l_partkey % 2 = 0 as ascending from lineitem"""


def steps(spark, sf):
    """One declared step per line item; a question is an order."""
    return table(spark, sf, "lineitem", heavy=True).select(
        F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("op_index"),
        F.col("l_partkey").alias("tie"),
        F.element_at(F.array(*[F.lit(t) for t in _STEP_TYPES]),
                     (1 + (F.col("l_orderkey") + F.col("l_partkey")) % 6).cast("int")).alias("op_type"),
        F.expr("case l_suppkey % 3 when 0 then 't1.unit_price' when 1 then 'order_date' else 'T2.customer_id' end")
        .alias("col"),
        F.expr("case l_partkey % 4 when 0 then '=' when 1 then '>=' when 2 then 'LIKE' else 'NOT IN' end").alias("op"),
        F.col("l_returnflag").alias("v1"),
        F.expr("case l_suppkey % 3 when 0 then 'COUNT' when 1 then 'SUM' else 'MAX' end").alias("func"),
        (1 + F.col("l_partkey") % 3).cast("int").alias("k"), (F.col("l_partkey") % 2 == 0).alias("ascending"))


def step_text_sql() -> str:
    name = D.humanize_column("col")
    cond = " ".join(f"when '{k}' then '{w}'" for k, w in T.CONDITION_TEXT.items())
    return f"""(case op_type when 'sem_filter' then 'The ' || {name} || ' ' || (case op {cond} else op end) || ' ' || v1
 when 'sem_join' then 'The ' || {name} || ' described in one document is the same as the key described in the other document.'
 when 'sem_cluster_by' then 'Group by ' || {name}
 when 'sem_agg' then case when func = 'COUNT' then 'The total count of ' || {name} else 'The ' || lower(func) || ' of ' || {name} end
 when 'sem_extract' then 'The ' || {name}
 when 'sem_topk' then case when k = 1 then 'The one with ' || case when ascending then 'lowest ' else 'highest ' end || {name}
 else 'Top ' || cast(k as varchar) || ' by ' || {name} || case when ascending then ' ascending' else ' descending' end end end)"""


def with_step_text(df):
    return df.withColumn("instruction", T.step_text(
        F.col("op_type"), F.col("col"), F.col("op"), F.col("v1"), F.col("func"), F.col("k"), F.col("ascending"),
        F.lit("t2.key")))


@query("txt_11_step_text", f"""select question_id, op_index, tie, op_type, {step_text_sql()} as instruction from ({STEPS_SQL})""")
def _(spark, sf):
    return with_step_text(steps(spark, sf)).select("question_id", "op_index", "tie", "op_type", "instruction")


_RAW_PREDICATE = """select event_id, case event_id % 4 when 0 then '((value)::numeric  > ' || cast(user_id as varchar) || '::integer)'
 when 1 then '(event_type = ''' || event_type || '''::text)' when 2 then 'user_id  =   ' || cast(user_id as varchar)
 else 'STRFTIME(''%Y'', ts) = 2024 OR t1.user_id = ' || cast(user_id as varchar) || ')' end as p from events"""


def _raw_predicates(spark, sf):
    return table(spark, sf, "events").select("event_id", F.expr(
        """case event_id % 4 when 0 then '((value)::numeric  > ' || cast(user_id as string) || '::integer)'
           when 1 then "(event_type = '" || event_type || "'::text)" when 2 then 'user_id  =   ' || cast(user_id as string)
           else "STRFTIME('%Y', ts) = 2024 OR t1.user_id = " || cast(user_id as string) || ')' end""").alias("p"))


@query("txt_12_clean_predicate", rf"""select event_id, case when regexp_matches(p, '^\(.+\)$') then
 trim(regexp_replace(p, '^\((.+)\)$', '\1')) else p end as cleaned from (select event_id, {D.squeeze(
     "regexp_replace(p, '(?i)::(?:text|integer|bigint|real|float|numeric|boolean|date|timestamp)" + chr(92) + "b', '', 'g')")} as p
 from ({_RAW_PREDICATE}))""")
def _(spark, sf):
    return _raw_predicates(spark, sf).select("event_id", T.clean_predicate(F.col("p")).alias("cleaned"))


_IS_RAW = r"""regexp_matches(p, '(?i)\b(?:STRFTIME|SUBSTR|JULIANDAY)\s*\(') or contains(p, '`')
 or regexp_matches(p, '\b[A-Za-z]\w*\.[A-Za-z]') or regexp_matches(p, '\bOR\b') or regexp_matches(p, '_[:%]|__\.')
 or len(regexp_extract_all(p, '\)')) > len(regexp_extract_all(p, '\('))"""


@query("txt_13_is_raw_sql_text", f"""select event_id, ({_IS_RAW}) as raw from ({_RAW_PREDICATE})""")
def _(spark, sf):
    return _raw_predicates(spark, sf).select("event_id", T.is_raw_sql_text(F.col("p")).alias("raw"))


_DRAFT = """select p_partkey, case p_partkey % 5 when 0 then 'The row value for ' || p_name || ' indicates that the value is recorded as  ' || p_brand
 when 1 then 'The Brand Name of ' || p_brand || ' is ' || p_name || '..' when 2 then '| Item Count (K-12) is ' || cast(p_size as varchar) || ' (Hash: 0a1b) |'
 when 3 then 'Enrollment (Total) of ' || p_name || '?' else p_type || ' ' || p_name end as s from part"""


@query("txt_14_clean_sentence", f"select p_partkey, {D.clean_sentence('s')} as cleaned from ({_DRAFT})")
def _(spark, sf):
    s = F.expr("""case p_partkey % 5 when 0 then 'The row value for ' || p_name || ' indicates that the value is recorded as  ' || p_brand
      when 1 then 'The Brand Name of ' || p_brand || ' is ' || p_name || '..' when 2 then '| Item Count (K-12) is ' || cast(p_size as string) || ' (Hash: 0a1b) |'
      when 3 then 'Enrollment (Total) of ' || p_name || '?' else p_type || ' ' || p_name end""")
    return table(spark, sf, "part").select("p_partkey", T.clean_sentence(s).alias("cleaned"))


_ODD = """select p_partkey, case p_partkey % 5 when 0 then 'The share of ' || p_name || ', which is [PLACEHOLDER]% here'
 when 1 then 'The share is NOT specified%,  ' when 2 then 'The ' || p_name || ', [PLACEHOLDER]% in all , .'
 when 3 then 'Share which is [PLACEHOLDER]%' else p_brand || ', which is [PLACEHOLDER]%' end as s from part"""


def _malformed_sql(x: str) -> str:
    for p, r, flag in [(r"([A-Za-z\s]+),\s+which\s+is\s+\[PLACEHOLDER\]%", r"\1 is [PLACEHOLDER]%", "g"),
                       (r"\bnot\s+specified%", "not specified", "gi"),
                       (r"([A-Za-z\s]+),\s+\[PLACEHOLDER\]%", r"\1 is [PLACEHOLDER]%", "g"),
                       (r"([A-Za-z\s]+)\s+which\s+is\s+\[PLACEHOLDER\]%", r"\1 is [PLACEHOLDER]%", "g"),
                       (r"\bwhich\s+is\s+(\[PLACEHOLDER\]%)", r"is \1", "g"), (D.SP, " ", "g"),
                       (r"\s*,\s*$", "", "g"), (r"\s*,\s*\.", ".", "g")]:
        x = f"regexp_replace({x}, '{p}', '{r}', '{flag}')"
    return f"trim({x})"


@query("txt_15_clean_malformed_variation", f"select p_partkey, {_malformed_sql('s')} as cleaned from ({_ODD})")
def _(spark, sf):
    s = F.expr("""case p_partkey % 5 when 0 then 'The share of ' || p_name || ', which is [PLACEHOLDER]% here'
      when 1 then 'The share is NOT specified%,  ' when 2 then 'The ' || p_name || ', [PLACEHOLDER]% in all , .'
      when 3 then 'Share which is [PLACEHOLDER]%' else p_brand || ', which is [PLACEHOLDER]%' end""")
    return table(spark, sf, "part").select("p_partkey", T.clean_malformed_variation(s).alias("cleaned"))


# RE2 has no look-around, so the oracle protects periods that touch a digit first
_PROTECT = r"""regexp_replace(regexp_replace(text, '(\d)\.', '\1' || chr(1), 'g'), '\.(\d)', chr(1) || '\1', 'g')"""
_STRIP = r"regexp_replace(s, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"


@query("txt_16_split_sentences", rf"""select doc_id, cast(len(s) as bigint) as n, md5(array_to_string(s, '#')) as joined from (
 select doc_id, list_filter(list_transform(regexp_split_to_array({_PROTECT}, '\.|[!?]+'),
 lambda s: replace({_STRIP}, chr(1), '.')), lambda s: length(s) > 10) as s from documents)""")
def _(spark, sf):
    s = T.split_sentences(F.col("text"))
    return table(spark, sf, "documents", heavy=True).select(
        "doc_id", F.size(s).cast("bigint").alias("n"), F.md5(F.array_join(s, "#")).alias("joined"))


@query("txt_16_split_narrative", r"""with n as (select page_id, '=====' || chr(10) || 'Sample report' || chr(10) ||
 case when page_id % 2 = 0 then '| ' || replace(url, 'example', 'site') || ' is up. | Host 3.5 (Hash: 0a) |' else replace(url, 'example', 'site') || ' is up. (Hash: 0a) Host 3.5 down! Ok' end as t from pages),
 k as (select page_id, split(t, chr(10))[3] as t from n)
 select page_id, case when page_id % 2 = 0 then array_to_string(list_filter(list_transform(split(t, '|'), lambda s: trim(s)), lambda s: s <> ''), '#')
 else array_to_string(list_filter(list_transform(regexp_split_to_array(replace(replace(regexp_replace(regexp_replace(t, '(\d)\.', '\1' || chr(1), 'g'), '\.(\d)', chr(1) || '\1', 'g'),
 '. (Hash:', chr(2)), chr(3), ''), '\.|[!?]+'), lambda s: replace(replace(trim(s), chr(1), '.'), chr(2), '. (Hash:')), lambda s: s <> ''), '#') end as sentences from k""")
def _(spark, sf):
    t = F.expr("""'=====\\nSample report\\n' || case when page_id % 2 = 0 then '| ' || replace(url, 'example', 'site') || ' is up. | Host 3.5 (Hash: 0a) |'
                  else replace(url, 'example', 'site') || ' is up. (Hash: 0a) Host 3.5 down! Ok' end""")
    return table(spark, sf, "pages", heavy=True).select("page_id", F.array_join(T.split_narrative(t), "#").alias("sentences"))


_LISTED = """'Variation 1: ' || role || ' says' || {nl} || '2) ' || replace(text, {nl}, {nl} || '- ')"""


@query("txt_17_parse_numbered_list", r"""select conv_id, turn, md5(array_to_string(list_filter(list_transform(string_split(a, chr(10)), lambda s: regexp_replace(regexp_replace(regexp_replace(
 regexp_replace(s, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '^\d+[.)]\s*', ''), '^[-•*]\s*', ''), '^Variation \d+:?\s*', '')), lambda s: length(s) > 10)[1:15], '#')) as wordings
 from (select conv_id, turn, """ + _LISTED.format(nl="chr(10)") + " as a from conversations)")
def _(spark, sf):
    answer = F.expr(_LISTED.format(nl="'\\n'"))
    return table(spark, sf, "conversations", heavy=True).select("conv_id", "turn", F.md5(F.array_join(
        T.parse_numbered_list(answer, 15), "#")).alias("wordings"))


WORD_SET = r"""list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'),
 '[\s\p{{Z}}]+'), lambda w: length(w) > 2))"""


@query("txt_18_word_set", f"""select doc_id, cast(len(w) as bigint) as n, md5(array_to_string(list_sort(w), ' ')) as words
 from (select doc_id, {WORD_SET.format(x='text')} as w from documents)""")
def _(spark, sf):
    w = T.word_set(F.col("text"))
    return table(spark, sf, "documents", heavy=True).select(
        "doc_id", F.size(w).cast("bigint").alias("n"), F.md5(F.array_join(F.array_sort(w), " ")).alias("words"))


@query("txt_19_estimate_tokens", """select conv_id, turn, cast(floor(length(text) / 4.0) as bigint) as tokens from conversations""")
def _(spark, sf):
    return table(spark, sf, "conversations", heavy=True).select("conv_id", "turn", T.estimate_tokens(F.col("text")).alias("tokens"))


_WORDS = vocab.TRUE_WORDS + vocab.FALSE_WORDS + vocab.NULL_WORDS_RENDER + ["other"]


@query("txt_20_null_and_binary_words", f"""select word, upper(word) in ({D.words(vocab.NULL_WORDS_RENDER)}) as is_null,
 upper(word) in ({D.words(vocab.TRUE_WORDS)}) as is_true, upper(word) in ({D.words(vocab.FALSE_WORDS)}) as is_false, count(*) as n
 from (select lower([{D.words(_WORDS)}][1 + o_orderkey % {len(_WORDS)}]) as word from orders) group by all""")
def _(spark, sf):
    word = F.lower(F.element_at(F.array(*[F.lit(w) for w in _WORDS]),
                                (1 + F.col("o_orderkey") % len(_WORDS)).cast("int")))
    w = F.col("word")
    return (table(spark, sf, "orders").select(word.alias("word"))
            .groupBy("word").agg(F.count("*").alias("n"))
            .select("word", T.is_null_word(w).alias("is_null"), T.is_true_word(w).alias("is_true"),
                    T.is_false_word(w).alias("is_false"), "n"))


def _phrase_sql(null_mode: str, binary_mode: str) -> str:
    parts = []
    for kind, phrases in T.detection_phrases(null_mode, binary_mode).items():
        hit = " or ".join(f"contains(lower(text), {D.q(p)})" for p in phrases)
        parts.append(f"cast(count(*) filter (where {hit}) as bigint) as {kind}_{null_mode}_{binary_mode}")
    return ", ".join(parts)


@query("txt_21_detection_phrases", f"""select source, {_phrase_sql('explicit', 'explicit')}, {_phrase_sql('implicit', 'implicit')}
 from documents group by source""")
def _(spark, sf):
    aggs = [F.count_if(T.holds_phrase(F.col("text"), phrases)).alias(f"{kind}_{mode}_{mode}")
            for mode in ("explicit", "implicit") for kind, phrases in T.detection_phrases(mode, mode).items()]
    return table(spark, sf, "documents", heavy=True).groupBy("source").agg(*aggs)
