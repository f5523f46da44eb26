"""Queries over evaluation (EVA), cost (CST), quality (QLT) and the SQL surface (UDF)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.functions import text as X
from textlake.operators import cost as C
from textlake.operators import evaluate as E
from textlake.operators import quality as Q
from textlake.operators.model import RuleModel, model_map
from textlake.plans import ducksql as D
from textlake.plans.banks import NOISE
from textlake.plans.base import query, table
from textlake.plans.corpora import customer_docs
from textlake.plans.fixtures import CALL_LOG, call_log, duck
from textlake.plans.gen import SENTENCES_SQL, document_sentences
from textlake.plans.txt import STEPS_SQL, steps
from textlake.session import scratch_path

# --- answers: one question per customer, truth from its orders, with planted errors ----
_TRUTH = "{fmt} as t"
ANSWERS_SQL = """select o_custkey as question_id, n, total, 's' || cast(o_custkey % 3 as varchar) as system, case when o_custkey % 2 = 0 then 'explicit' else 'implicit' end as null_mode,
 case when o_custkey % 13 = 0 then []::varchar[] when o_custkey % 11 = 0 then ['wrong ' || cast(n + 1 as varchar)] when o_custkey % 7 = 0 then [printf('%.2f', total + 0.005), cast(n as varchar)]
 when o_custkey % 5 = 0 then [cast(n as varchar) || ' Orders', printf('%.2f', total)] else [cast(n as varchar), printf('%.2f', total) || ' orders'] end as extracted,
 case when o_custkey % 17 = 0 then []::varchar[] else [cast(n as varchar) || ' orders', printf('%.2f', total)] end as ground_truth,
 cast(n as double) / 4 as seconds, n * 10 as tokens, cast(n as double) / 1000 as cost
 from (select o_custkey, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from orders group by 1)"""


def answers(spark, sf):
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    k = F.col("o_custkey")
    n, t = F.col("n").cast("string"), X.number_format(F.col("total"), 2)
    none = F.array().cast("array<string>")
    extracted = (F.when(k % 13 == 0, none).when(k % 11 == 0, F.array(F.concat(F.lit("wrong "), (F.col("n") + 1).cast("string"))))
                 .when(k % 7 == 0, F.array(X.number_format(F.col("total") + 0.005, 2), n))
                 .when(k % 5 == 0, F.array(F.concat(n, F.lit(" Orders")), t)).otherwise(F.array(n, F.concat(t, F.lit(" orders")))))
    return per.select(
        k.alias("question_id"), "n", "total", F.concat(F.lit("s"), (k % 3).cast("string")).alias("system"),
        F.when(k % 2 == 0, "explicit").otherwise("implicit").alias("null_mode"), extracted.alias("extracted"),
        F.when(k % 17 == 0, none).otherwise(F.array(F.concat(n, F.lit(" orders")), t)).alias("ground_truth"),
        (F.col("n").cast("double") / 4).alias("seconds"), (F.col("n") * 10).alias("tokens"), (F.col("n").cast("double") / 1000).alias("cost"))


def _norm(x: str) -> str:
    return f"array_to_string(list_sort(regexp_extract_all(lower(array_to_string({x}, ' ')), '[a-z0-9]+')), ' ')"


def _nums(x: str) -> str:
    return f"list_transform(regexp_extract_all(array_to_string({x}, ' '), '[-+]?\\d*\\.?\\d+(?:[eE][-+]?\\d+)?'), lambda s: try_cast(s as double))"


MATCH_SQL = f"""case when len(ground_truth) = 0 then len(extracted) = 0 else {_norm('extracted')} = {_norm('ground_truth')} or coalesce(len({_nums('ground_truth')}) > 0 and len({_nums('extracted')}) > 0
 and len(list_filter({_nums('ground_truth')}, lambda g: len(list_filter({_nums('extracted')}, lambda e: abs(e - g) <= 0.01)) = 0)) = 0, false) end"""
SCORED_SQL = f"select *, {MATCH_SQL} as correct from ({ANSWERS_SQL})"


@query("eva_1_normalize_answer", f"select question_id, {_norm('extracted')} as answer from ({ANSWERS_SQL})")
def _(spark, sf):
    return answers(spark, sf).select("question_id", X.normalize_answer(F.col("extracted")).alias("answer"))


@query("eva_2_numbers_in", f"select question_id, len(x) as n, list_sum(x) as total from (select question_id, {_nums('ground_truth')} as x from ({ANSWERS_SQL})) where len(x) > 0")
def _(spark, sf):
    a = answers(spark, sf).select("question_id", X.numbers_in(F.col("ground_truth")).alias("x")).where(F.size("x") > 0)
    return a.select("question_id", F.size("x").cast("bigint").alias("n"),
                    F.aggregate("x", F.lit(0.0), lambda s, v: s + v).alias("total"))


@query("eva_3_answers_match", f"select question_id, correct from ({SCORED_SQL})")
def _(spark, sf):
    return E.score(answers(spark, sf)).select("question_id", "correct")


@query("eva_4_ground_truth", """select string_agg(a, ';' order by a) as answers from (select cast(c_nationkey as varchar) || ', ' || cast(count(*) as varchar) as a from
 (select * from customer order by c_custkey limit 1000) group by c_nationkey)""")
def _(spark, sf):
    heads = E.head_tables({"customer": (table(spark, sf, "customer"), "c_custkey")}, 1000)
    truth = E.ground_truth(spark, "select c_nationkey, count(*) as n from {customer} group by c_nationkey", heads)
    return E.as_answer_list(truth).select(F.array_join("answers", ";").alias("answers"))


_SUMMARY = """count(*)::double as total_questions, round(cast(sum(cast(seconds as decimal(28,6))) as double), 4) as total_execution_time_seconds, sum(tokens)::double as total_llm_tokens,
 round(cast(sum(cast(cost as decimal(28,9))) as double), 6) as total_llm_cost, count(*) filter (where correct)::double as num_correct, round(count(*) filter (where correct) / count(*)::double, 4) as accuracy"""


@query("eva_5_metrics_summary", f"""with s as (select {_SUMMARY}, 2.0::double as num_skipped_unsupported from ({SCORED_SQL})) unpivot s on columns(*) into name metric value value""")
def _(spark, sf):
    return E.metrics_summary(E.score(answers(spark, sf)), skipped=2)


@query("eva_6_compare_systems", f"select system, null_mode, {_SUMMARY} from ({SCORED_SQL}) group by 1, 2")
def _(spark, sf):
    return E.compare_systems(E.score(answers(spark, sf)), ["system", "null_mode"])


@query("eva_6_accuracy_table", f"select null_mode, " + ", ".join(
    f"round(count(*) filter (where correct and system = 's{i}') / cast(count(*) filter (where system = 's{i}') as double), 4) as s{i}" for i in range(3)) + f" from ({SCORED_SQL}) group by 1")
def _(spark, sf):
    return E.accuracy_table(E.score(answers(spark, sf)), ["null_mode"], ["s0", "s1", "s2"])


_QUESTIONS = "select o_orderkey as question_id, o_orderkey + 1 as line_no, o_orderpriority as difficulty, 'db' || cast(o_custkey % 11 as varchar) as db_id from orders"


def questions(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("question_id"), (F.col("o_orderkey") + 1).alias("line_no"), F.col("o_orderpriority").alias("difficulty"),
        F.concat(F.lit("db"), (F.col("o_custkey") % 11).cast("string")).alias("db_id"))


@query("eva_7_filter_by_ops", f"""select question_id from ({_QUESTIONS}) where question_id in (select question_id from ({STEPS_SQL}) where op_type in ('sem_topk', 'sem_join'))
 and difficulty in ('1-URGENT', '5-LOW') and db_id in ('db1', 'db2', 'db3')""")
def _(spark, sf):
    return E.filter_by_ops(questions(spark, sf), steps(spark, sf), ["topk", "join"], ["1-URGENT", "5-LOW"],
                           ["db1", "db2", "db3"]).select("question_id")


@query("eva_8_merge_questions", f"""select question_id, line_no, case when question_id % 3 <> 0 then 'plan' || cast(question_id as varchar) end as semantic,
 case when question_id % 4 <> 0 then 'SELECT ' || cast(question_id as varchar) end as sql_sqlite from ({_QUESTIONS})""")
def _(spark, sf):
    q = questions(spark, sf)
    key = F.col("question_id").cast("string")
    plans = q.where("question_id % 3 <> 0").select("line_no", F.concat(F.lit("plan"), key).alias("semantic"))
    other = q.where("question_id % 4 <> 0").select("question_id", F.concat(F.lit("SELECT "), key).alias("sql_sqlite"))
    return E.merge_questions(q, plans, other).select("question_id", "line_no", "semantic", "sql_sqlite")


@query("eva_9_cache_complete", """select count(*) filter (where doc_id not in (select doc_id from labels)) as missing, 0::bigint as extra, count(*) filter (where doc_id not in (select doc_id from labels)) = 0 as complete,
 (select cast(count(*) as varchar) || ':' || cast(sum(('0x' || substr(sha256('v' || cast(doc_id as varchar) || chr(31) || coalesce('v' || lang, 'n')), 1, 15))::BIGINT) as varchar) from documents) as hash from documents""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    check = E.cache_complete(table(spark, sf, "labels").select(F.col("doc_id").alias("question_id")),
                             d.select(F.col("doc_id").alias("question_id")), 6, 6)
    return check.withColumn("hash", d.agg(E.content_hash(d, ["doc_id", "lang"])).scalar())


@query("eva_10_op_histogram", f"""select case when op_type like '%join%' then 'join' when op_type in ('sem_agg', 'sem_cluster_by') then 'aggregate' when op_type = 'sem_topk' then 'sort' else 'other' end as op_class,
 op_type, count(*) as n from ({STEPS_SQL}) group by 1, 2""")
def _(spark, sf):
    return E.op_histogram(steps(spark, sf))


_FORMAT = """case o_orderkey % 5 when 0 then 'FILTER: a && OP: ratio' when 1 then 'AGGREGATE: x | OP: >,- / EXTRACT: y' when 2 then 'OP: percent reverse, FILTER: z' when 3 then 'OP: total "' else 'EXTRACT: ' || o_orderstatus end"""


@query("eva_11_op_token_catalog", """select token from (select distinct case o_orderkey % 5 when 0 then 'ratio' when 1 then '>,-' when 2 then 'percent reverse' when 3 then 'total' end as token from orders) where token is not null""")
def _(spark, sf):
    return E.op_token_catalog(table(spark, sf, "orders").select(F.expr(_FORMAT).alias("format")))


# --- cost ------------------------------------------------------------------------------
_CALLS = duck(CALL_LOG)
_MODEL = "case model when 'm0' then 'gpt-4o' when 'm1' then 'gpt-4o-mini' else 'local-llm' end"
_COST = "tin / 1000000.0::double * case model when 'gpt-4o' then 5.0 when 'gpt-4o-mini' then 0.15 else 0.0 end::double + tout / 1000000.0::double * case model when 'gpt-4o' then 15.0 when 'gpt-4o-mini' then 0.6 else 0.0 end::double"


def calls(spark, sf):
    name = F.expr("case model when 'm0' then 'GPT-4o-2024' when 'm1' then 'gpt4o-mini' else 'my-oss' end")
    return call_log(spark, sf).withColumn("model", name)


_USAGE = f"select {_MODEL} as model, cast(sum(input_tokens) as bigint) as tin, cast(sum(output_tokens) as bigint) as tout, count(*) as n from ({_CALLS}) group by 1"


@query("cst_1_usage_by_model", f"select model, tin as input_tokens, tout as output_tokens, n as call_count from ({_USAGE})")
def _(spark, sf):
    return C.usage_by_model(calls(spark, sf))


@query("cst_2_cost", f"select model, round({_COST}, 9) as cost from ({_USAGE})")
def _(spark, sf):
    return C.with_cost(C.usage_by_model(calls(spark, sf))).select("model", F.round("cost", 9).alias("cost"))


@query("cst_3_calls_by_operation", f"""select op as operation, count(*) as n from (select [{D.words(C.OPERATIONS + ['other'])}][1 + (conv_id + turn) % 14] as op from conversations) where op <> 'other' group by 1""")
def _(spark, sf):
    op = F.element_at(F.array(*[F.lit(o) for o in C.OPERATIONS + ["other"]]), (1 + (F.col("conv_id") + F.col("turn")) % 14).cast("int"))
    return C.calls_by_operation(table(spark, sf, "conversations").select(op.alias("operation")))


_KINDS = ["descriptors", "reused_descriptors", "db_contexts", "table_contexts", "templates", "sentence_variations", "enhancements"]


def _stage_cost(kind: str) -> str:
    model, tin, tout = C.STAGE_TOKENS["descriptors" if kind == "reused_descriptors" else kind]
    pin, pout = C.PRICES[model]
    return f"when '{kind}' then n * {tin} / 1000000.0::double * {pin}::double + n * {tout} / 1000000.0::double * {pout}::double"


@query("cst_4_savings", f"""select kind, n, round(case kind {" ".join(_stage_cost(k) for k in _KINDS)} end, 9) as saved from (select [{D.words(_KINDS)}][1 + doc_id % 7] as kind, count(*) as n from documents group by 1)""")
def _(spark, sf):
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (1 + F.col("doc_id") % 7).cast("int"))
    skipped = table(spark, sf, "documents").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    return C.savings(skipped).withColumn("saved", F.round("saved", 9))


def _stage_rows() -> str:
    s = f"(n_tables * {C.SENTENCES_PER_TABLE})"
    b = f"(n_tables * {C.BINARY_NULL_PER_TABLE})"
    n = {"descriptors": "n_tables * n_columns", "db_contexts": "least(n_tables // 10, 50)", "table_contexts": "n_tables", "templates": "n_tables",
         "structural_variations": f"{s} + {b}", "lexical_filter": f"{s} * 6", "field_detection": f"{s} * 30", "value_replacement": f"{s} * 15 // 5", "counter_refinement": f"{b} * 15"}
    rows = []
    for stage, calls_ in n.items():
        model, tin, tout = C.STAGE_TOKENS[stage]
        pin, pout = C.PRICES[model]
        rows.append(f"select source, '{stage}' as stage, '{model}' as model, cast({calls_} as bigint) as calls, cast(({calls_}) * {tin} as bigint) as input_tokens, cast(({calls_}) * {tout} as bigint) as output_tokens, "
                    f"round(({calls_}) * {tin} / 1000000.0::double * {pin}::double + ({calls_}) * {tout} / 1000000.0::double * {pout}::double, 9) as cost from sizes")
    return " union all ".join(rows)


@query("cst_5_full_run_estimate", f"with sizes as (select source, count(*) as n_tables, 10 + count(distinct lang) as n_columns from documents group by 1) {_stage_rows()}")
def _(spark, sf):
    sizes = table(spark, sf, "documents").groupBy("source").agg(
        F.count("*").alias("n_tables"), (10 + F.countDistinct("lang")).alias("n_columns"))
    return C.full_run_estimate(sizes).withColumn("cost", F.round("cost", 9))


@query("cst_6_cost_report", f"""with u as ({_USAGE}), c as (select model, n, tin, tout, {_COST} as cost from u) select coalesce(model, 'total') as model, cast(sum(n) as bigint) as call_count, cast(sum(tin) as bigint) as input_tokens, cast(sum(tout) as bigint) as output_tokens,
 round(sum(cost), 9) as cost, (select max(conv_id) * 60.0 + 600.0 from conversations)::double as duration_seconds from c group by rollup (model)""")
def _(spark, sf):
    ts = F.timestamp_seconds(F.col("conv_id") * 60)
    log = calls(spark, sf).withColumn("ts", ts)
    ends = log.agg(F.max("conv_id").alias("m")).select(F.timestamp_seconds(F.col("m") * 60 + 600).alias("ts"))
    report = C.cost_report(log.unionByName(log.limit(0)).withColumn("ts", F.when(F.col("turn") == 0, F.col("ts")).otherwise(ends.scalar())))
    return report


@query("cst_7_op_cost_dedup", """with o as (select l_suppkey, l_partkey as op_id, min((l_orderkey, l_linenumber, l_quantity, l_extendedprice)) as f from lineitem group by 1, 2)
 select l_suppkey, count(*) as n_ops, cast(sum(cast(f[3] as decimal(18,2))) as double) as seconds, cast(sum(cast(f[4] as decimal(18,2))) as double) as cost, cast(sum(f[2]) as bigint) as tokens from o group by 1""")
def _(spark, sf):
    stats = table(spark, sf, "lineitem").select(
        "l_suppkey", F.col("l_partkey").alias("op_id"), F.struct("l_orderkey", "l_linenumber").alias("path"),
        F.col("l_quantity").alias("seconds"), F.col("l_extendedprice").alias("cost"), F.col("l_linenumber").cast("bigint").alias("tokens"))
    return C.op_cost_dedup(stats, ["l_suppkey"])


# --- quality -----------------------------------------------------------------------------

@query("qlt_1_column_diff", """select p_partkey, case p_partkey % 3 when 1 then 'size' else '' end as missing, case p_partkey % 3 when 1 then 'weight' else '' end as extra, p_partkey % 3 = 0 as same_order from part""")
def _(spark, sf):
    part = table(spark, sf, "part")
    want = part.select("p_partkey", F.expr("inline(array(struct(1 as ordinal, 'brand' as field), struct(2 as ordinal, 'size' as field)))"))
    got = part.select("p_partkey", F.expr("""inline(array(struct(1 as ordinal, case when p_partkey % 3 = 2 then 'size' else 'brand' end as field),
        struct(2 as ordinal, case p_partkey % 3 when 0 then 'size' when 1 then 'weight' else 'brand' end as field)))"""))
    return Q.column_diff(want, got, ["p_partkey"]).withColumns({c: F.array_join(c, ",") for c in ("missing", "extra")})


@query("qlt_2_sentence_uniqueness", f"""with d as ({SENTENCES_SQL}) select count(*) as n_docs, cast(sum(len(s)) as bigint) as n_all, round(sum(len(s) - len(list_distinct(s))) / count(*)::double, 6) as mean_duplicates,
 (select count(distinct x) from (select unnest(s) as x from d)) as n_distinct, round((select count(distinct x) from (select unnest(s) as x from d)) / sum(len(s))::double, 6) as distinct_ratio from d""")
def _(spark, sf):
    return Q.sentence_uniqueness(document_sentences(spark, sf).withColumnRenamed("s", "sentences"))


@query("qlt_3_unfilled_placeholders", "select page_id from pages where page_id % 4 = 0 or regexp_matches(html, '\\[([^\\]]+)\\]')")
def _(spark, sf):
    t = table(spark, sf, "pages").select("page_id", F.expr("html || case when page_id % 4 = 0 then ' [URL] ' else '' end").alias("t"))
    return Q.unfilled_placeholders(t, "page_id", "t")


@query("qlt_4_sentence_quality", rf"""select lang, count(*) as n, round(sum(length(x)) / count(*)::double, 6) as mean_length, count(*) filter (where regexp_matches(x, '[.!?]$')) as proper_ends,
 count(*) filter (where regexp_matches(x, '\d+|[A-Z][a-z]+\s+[A-Z][a-z]+|%')) as data_like from (select lang, unnest(list_transform(range(len(s)), lambda i: case when i % 2 = 0 then s[i + 1] || '.' else s[i + 1] end)) as x
 from ({SENTENCES_SQL}) join (select doc_id, lang from documents) using (doc_id)) group by lang""")
def _(spark, sf):
    s = X.split_sentences(F.col("text"))
    ended = F.transform(s, lambda x, i: F.when(i % 2 == 0, F.concat(x, F.lit("."))).otherwise(x))
    rows = table(spark, sf, "documents", heavy=True).select("lang", F.explode(ended).alias("sentence"))
    return Q.sentence_quality(rows, keys=["lang"])


@query("qlt_5_schema_language", """select doc_id from (select doc_id, lower(text || case doc_id % 9 when 0 then ' a Row Value' when 1 then ' one database' when 2 then ' field  value' else '' end) as t from documents)
 where contains(t, 'row value') or contains(t, 'database') or contains(t, 'table') or contains(t, 'field value') or contains(t, 'data entry')""")
def _(spark, sf):
    t = table(spark, sf, "documents", heavy=True).select("doc_id", F.expr(
        "text || case doc_id % 9 when 0 then ' a Row Value' when 1 then ' one database' when 2 then ' field  value' else '' end").alias("t"))
    return Q.schema_language(t, "doc_id", "t")


# --- model stage and SQL surface ---------------------------------------------------------

@query("mod_1_model_map", """select event_id, case when event_type = 'click' then 'cached' else 'The type is ' || event_type || '.' end as answer from events""")
def _(spark, sf):
    prompt = F.concat_ws("\t", F.lit("state"), F.lit("type"), "event_type")
    rows = table(spark, sf, "events").select("event_id", prompt.alias("prompt_text"))
    cache = rows.where(F.col("prompt_text").endswith("click")).select(
        F.col("prompt_text").alias("prompt"), F.lit("cached").alias("answer")).distinct()
    out = model_map(rows, "prompt_text", RuleModel(), "answer", cache, scratch_path(spark, "answers"))
    return out.select("event_id", "answer")


class PickyModel(RuleModel):
    """Fails on a whole batch when it holds a prompt about a number that ends in 97."""

    def answer(self, prompts):
        if any(p.endswith("97") for p in prompts):
            raise ValueError("number refused")
        return super().answer(prompts)


@query("mod_1_failing_prompts", """select o_orderkey, case when o_orderkey % 100 <> 97 then 'The customer is ' || o_custkey || ' of order ' || o_orderkey || '.' end as answer,
 case when o_orderkey % 100 = 97 then 'failed' else 'answered' end as answer_status, case when o_orderkey % 100 = 97 then 'ValueError: number refused' end as answer_error from orders""")
def _(spark, sf):
    prompt = F.concat(F.lit("state\tcustomer\t"), "o_custkey", F.lit(" of order "), "o_orderkey")
    rows = table(spark, sf, "orders").select("o_orderkey", prompt.alias("prompt_text"))
    out = model_map(rows, "prompt_text", PickyModel(), cache_path=scratch_path(spark, "answers"), keep_errors=True)
    return out.select("o_orderkey", "answer", "answer_status", "answer_error")


@query("udf_2_sql_functions", f"""select doc_id, md5({D.strip_tags("text || ' (Hash: 0a1b) |'")}) as plain, cast(length(text) // 4 as bigint) as tokens, 'order date' as name from documents""")
def _(spark, sf):
    X.register(spark)
    return spark.sql("""select doc_id, md5(tl_strip_tags(text || ' (Hash: 0a1b) |')) as plain, tl_estimate_tokens(text) as tokens,
        tl_humanize_column('t1.order_date') as name from {d}""", d=table(spark, sf, "documents"))


@query("udf_3_extract_fields", """select c_custkey as row_id, field, case field when 'c_name' then c_name else c_mktsegment end as value from customer, (values ('c_name'), ('c_mktsegment')) v(field)""")
def _(spark, sf):
    from textlake.functions.udtf import register_extract_fields
    from textlake.plans.banks import customer_bank
    from textlake.plans.corpora import stored
    bank = [t for t in customer_bank() if t.field in ("c_name", "c_mktsegment")]
    register_extract_fields(spark, bank)
    return spark.sql("select row_id, f.field, f.value from {docs}, lateral extract_fields(contents) f",
                     docs=stored(spark, sf, customer_docs))


@query("gen_12_noise_share", f"""select c_custkey as row_id, 8::integer as n_data, 8::integer as n_noise from customer""")
def _(spark, sf):
    docs = customer_docs(spark, sf, "implicit", "implicit", (1, 1))
    noise = F.size(F.filter("sentences", lambda s: s.isin(NOISE)))
    return docs.select("row_id", (F.size("sentences") - noise).alias("n_data"), noise.alias("n_noise"))
