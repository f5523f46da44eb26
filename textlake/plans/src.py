"""Queries over readers and writers (SRC, SNK). Files go to a fresh path in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.plans import ducksql as D
from textlake.plans.base import query, table
from textlake.plans.fixtures import LONG_CTE, PROFILE_FIELDS, PROFILE_ROWS, duck, profile_rows
from textlake.plans.txt import steps
from textlake.operators.profile import unpivot_rows
from textlake.session import scratch_path
from textlake.sources import readers as R
from textlake.sources import sinks as S


@query("src_1_read_table", """select cast(c_custkey as varchar) as c_custkey, c_name, cast(c_nationkey as varchar) as c_nationkey,
 cast(c_acctbal as varchar) as c_acctbal, c_mktsegment from customer order by customer.c_custkey limit 100""")
def _(spark, sf):
    return R.read_table(table(spark, sf, "customer"), "c_custkey", 100, as_text=True)


_CATALOG = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
            "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
            "events": ["event_id", "ts", "user_id", "event_type", "value", "props"]}
_TYPE_OF = {"c_nationkey": "int", "c_acctbal": "double", "o_totalprice": "double", "o_orderdate": "timestamp_ntz",
            "ts": "timestamp_ntz", "value": "double", "c_custkey": "bigint", "o_orderkey": "bigint",
            "o_custkey": "bigint", "event_id": "bigint", "user_id": "bigint"}


@query("src_2_column_catalog", " union all ".join(
    f"select '{t}' as table_name, cast({i + 1} as integer) as ordinal, '{c}' as column_name, "
    f"'{_TYPE_OF.get(c, 'string')}' as data_type, count({c}) = count(*) as not_null, count(*) as n_rows from {t}"
    for t, cols in _CATALOG.items() for i, c in enumerate(cols)))
def _(spark, sf):
    return R.column_catalog({t: table(spark, sf, t) for t in _CATALOG})


@query("src_3_read_kv_rows", """select p_partkey, p_name, p_brand, cast(cast(p_retailprice as decimal(18,2)) as double) as price,
 cast(6 as integer) as n_fields from part""")
def _(spark, sf):
    path = scratch_path(spark, "kv")
    S.export_kv_rows(table(spark, sf, "part"), path)
    f = F.col("fields")
    return R.read_kv_rows(spark, path).select(
        f["p_partkey"].cast("bigint").alias("p_partkey"), f["p_name"].alias("p_name"), f["p_brand"].alias("p_brand"),
        f["p_retailprice"].cast("double").alias("price"), F.size(f).alias("n_fields"))


@query("src_4_read_corpus", """select 'customer' || cast(c_custkey as varchar) || '.txt' as filename, c_custkey as row_id,
 c_name || ' is in ' || c_mktsegment || '.' as contents from customer""")
def _(spark, sf):
    path = scratch_path(spark, "corpus")
    docs = table(spark, sf, "customer").select(
        F.concat(F.lit("customer"), F.col("c_custkey").cast("string"), F.lit(".txt")).alias("filename"),
        F.concat(F.lit("| "), "c_name", F.lit(" is in "), "c_mktsegment", F.lit(". (Hash: 0a1b) |")).alias("contents"))
    S.write_corpus(docs.withColumn("contents", F.trim(F.regexp_replace("contents", r"^\| | \|$", ""))), path)
    return R.read_corpus(spark, path)


_TAG = "substr(md5(p_name || '|' || cast(p_partkey as varchar)), 1, 16)"


@query("src_5_read_sentence_templates", f"""select 'parts' as database, 't' || cast(p_partkey as varchar) as "table", cast(pos as integer) as pos,
 case pos when 0 then {_TAG} end as tag, case pos when 0 then 'p_name' end as field, case pos when 0 then p_name end as value,
 case pos when 0 then 'The item is ' || p_name || '. (Hash: ' || {_TAG} || ')' else 'It is kept in stock.' end as sentence,
 'explicit' as null_mode, 'implicit' as binary_mode, '1:1' as data_noise_ratio from part, (values (0), (1)) v(pos)""")
def _(spark, sf):
    tag = F.substring(F.md5(F.concat("p_name", F.lit("|"), F.col("p_partkey").cast("string"))), 1, 16)
    rows = table(spark, sf, "part").select(
        F.lit("parts").alias("database"), F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("table"),
        F.lit(0).alias("entry_index"), F.create_map(F.lit("p_name"), "p_name").alias("original_data"),
        F.array(F.concat(F.lit("The item is "), "p_name", F.lit(". (Hash: "), tag, F.lit(")")),
                F.lit("It is kept in stock.")).alias("generated_sentences"),
        F.lit("explicit").alias("null_mode"), F.lit("implicit").alias("binary_mode"),
        F.lit("1:1").alias("data_noise_ratio"), F.create_map(tag, F.lit("p_name")).alias("hash_to_column"))
    path = scratch_path(spark, "templates")
    rows.write.json(path)
    return R.read_sentence_templates(spark, path, multi_line=False)


@query("src_6_read_narratives", """select 'parts' as database, 't' || cast(p_partkey as varchar) as "table", '1:1' as data_noise_ratio,
 cast(pos as integer) as pos, case pos when 0 then 'Item ' || p_name || '. (Hash: 0a1b)' else 'Stock is fine.' end as segment,
 case pos when 0 then '0a1b' end as tag from part, (values (0), (1)) v(pos)""")
def _(spark, sf):
    rows = table(spark, sf, "part").select(
        F.lit("parts").alias("database"), F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("table"),
        F.array(F.concat(F.lit("| Item "), "p_name", F.lit(". (Hash: 0a1b) |")), F.lit("| Stock is fine. |")).alias("narrative"),
        F.lit("1:1").alias("data_noise_ratio"))
    path = scratch_path(spark, "narratives")
    rows.write.json(path)
    return R.read_narratives(spark, path, multi_line=False)


@query("src_7_read_bank", """select 'parts' as database, 't' || cast(p_partkey as varchar) as "table", cast(0 as integer) as tmpl_ix,
 'p_size' as field, pool, cast(vid as integer) as vid, case pool when 'std' then case vid when 0 then 'Size [P_SIZE] of ' || p_name || '.'
 else 'It measures [P_SIZE].' end else 'No size for ' || p_name || '.' end as pattern, false as is_static,
 'big' as first_synonym from part, (values ('std', 0), ('std', 1), ('counter', 0)) v(pool, vid)""")
def _(spark, sf):
    std = F.concat(F.lit("Size [P_SIZE] of "), "p_name", F.lit("."))
    rows = table(spark, sf, "part").select(
        F.lit("parts").alias("database"), F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("table"),
        F.array(F.struct(std.alias("template_pattern"), F.array(F.lit("p_size")).alias("primary_data_fields"),
                         F.array(std, F.lit("It measures [P_SIZE]."), std).alias("variations"),
                         F.array(F.concat(F.lit("No size for "), "p_name", F.lit("."))).alias("counter_variations"),
                         F.create_map(F.lit("size"), F.array(F.lit("big"), F.lit("extent"))).alias("lexical_sets"),
                         F.lit(False).alias("is_static"))).alias("templates"))
    path = scratch_path(spark, "bank")
    rows.write.json(path)
    bank = R.read_bank(spark, path, multi_line=False)
    return bank.withColumn("first_synonym", F.col("lexical_sets")["size"][0]).drop("lexical_sets", "others", "variation_class")


@query("src_8_join_column_descriptions", """select 'col_' || cast(p_partkey as varchar) as original_name,
 case when p_partkey % 3 = 0 then 'col_' || cast(p_partkey as varchar) else p_name end as display_name,
 case when p_partkey % 4 = 0 then null else p_type || ', "as sold"' end as column_description from part""")
def _(spark, sf):
    part = table(spark, sf, "part")
    name = F.concat(F.lit("col_"), F.col("p_partkey").cast("string"))
    csv = part.where(F.col("p_partkey") % 4 != 0).select(
        F.upper(name).alias("original_column_name"),
        F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.col("p_name")).alias("column_name"),
        F.concat("p_type", F.lit(', "as sold"')).alias("column_description"), F.lit("").alias("value_description"),
        F.lit("text").alias("data_format"))
    csv = csv.unionByName(part.where((F.col("p_partkey") % 4 == 0) & (F.col("p_partkey") % 3 != 0)).select(
        name.alias("original_column_name"), F.col("p_name").alias("column_name"),
        F.lit(None).cast("string").alias("column_description"), F.lit("").alias("value_description"),
        F.lit("text").alias("data_format")))
    path = scratch_path(spark, "descriptions")
    csv.write.csv(path, header=True, escape='"')
    joined = R.join_column_descriptions(part.select(name.alias("original_name")),
                                        R.read_column_descriptions(spark, path))
    return joined.select("original_name", "display_name", "column_description")


@query("src_9_read_workload", """select line_no, 'SELECT ' || cast(o_orderkey as varchar) as sql, 'db' || cast(o_orderkey % 11 as varchar) as db_id
 from (select o_orderkey, row_number() over (partition by o_orderkey % 16 order by o_orderkey) as line_no from orders) where o_orderkey % 10 <> 3""")
def _(spark, sf):
    # sixteen workload files, each in key order; every tenth line is blank or malformed
    line = F.expr("""case when o_orderkey % 10 = 3 then case when o_orderkey % 20 = 3 then '' else 'SELECT without db' end
                     else 'SELECT ' || cast(o_orderkey as string) || '\\tdb' || cast(o_orderkey % 11 as string) end""")
    path = scratch_path(spark, "workload")
    orders = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 16).alias("part"), line.alias("value"))
    (orders.repartition(16, "part").sortWithinPartitions("part", "o_orderkey").select("part", "value")
     .write.partitionBy("part").text(path))
    return R.read_workload(spark, path)


@query("src_10_copy_table_typed", """select cast(s_suppkey as bigint) as s_suppkey, s_name, cast(s_nationkey as bigint) as s_nationkey,
 s_acctbal, (select count(*) from supplier) as copied from supplier""")
def _(spark, sf):
    path = scratch_path(spark, "copy")
    n = S.copy_table(table(spark, sf, "supplier"), {"s_suppkey": "INTEGER", "s_name": "VARCHAR(25)",
                                                    "s_nationkey": "int", "s_acctbal": "REAL"}, path)
    return S.stored(spark, path).withColumn("copied", F.lit(n).cast("bigint"))


@query("snk_1_export_kv_rows", """select 'key: ' || cast(n_nationkey as varchar) || chr(10) || 'n_name: ' || n_name || chr(10) || 'n_regionkey: ' ||
 cast(n_regionkey as varchar) as content, c.n as n_customers from nation join (select c_nationkey, count(*) as n from customer group by 1) c
 on c_nationkey = n_nationkey""")
def _(spark, sf):
    path = scratch_path(spark, "kv")
    S.export_kv_rows(table(spark, sf, "nation"), path, {"n_nationkey": "key"})
    rows = R.read_kv_rows(spark, path).withColumn("c_nationkey", F.col("fields")["key"].cast("int"))
    per_nation = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n_customers"))
    return rows.join(per_nation, "c_nationkey").select("content", "n_customers")


def _sentences(spark, sf):
    return unpivot_rows(profile_rows(spark, sf), "row_id").where("value is not null").select(
        "row_id", "field", F.concat(F.lit("The "), "field", F.lit(" is "), "value", F.lit(".")).alias("sentence"))


@query("snk_2_to_multi_column", f"""with p as ({duck(PROFILE_ROWS)}) select row_id, """ + ", ".join(
    f"coalesce('The {f} is ' || {f} || '.', '') as {f}" for f in PROFILE_FIELDS) + " from p")
def _(spark, sf):
    path = scratch_path(spark, "multi")
    S.to_multi_column(_sentences(spark, sf), PROFILE_FIELDS).write.csv(path, header=True, emptyValue="")
    schema = "row_id bigint, " + ", ".join(f"{f} string" for f in PROFILE_FIELDS)
    return spark.read.csv(path, header=True, schema=schema).na.fill("", subset=PROFILE_FIELDS)


@query("snk_3_to_single_column", f"""{LONG_CTE} select row_id, field as field_name, 'The ' || field || ' is ' || value || '.' as sentence
 from l where value is not null""")
def _(spark, sf):
    path = scratch_path(spark, "single")
    S.to_single_column(_sentences(spark, sf)).write.csv(path, header=True)
    return spark.read.csv(path, header=True, schema="row_id bigint, field_name string, sentence string")


@query("snk_4_write_corpus_files", """select 'supplier' || cast(s_suppkey as varchar) || '.txt' as filename, s_suppkey as row_id,
 s_name || ' trades.' as contents from supplier""")
def _(spark, sf):
    path = scratch_path(spark, "files").removeprefix("file:")
    docs = table(spark, sf, "supplier").select(
        F.concat(F.lit("supplier"), F.col("s_suppkey").cast("string"), F.lit(".txt")).alias("filename"),
        F.concat("s_name", F.lit(" trades. (Hash: 0a1b)")).alias("contents"))
    S.write_corpus(docs, path, as_files=True)
    return R.read_corpus(spark, "file:" + path, layout="files")


@query("snk_5_append_missing", """select case when l.doc_id is null then 'produced' else 'skipped' end as status, count(*) as n
 from documents d left join (select distinct doc_id from labels) l on d.doc_id = l.doc_id group by 1""")
def _(spark, sf):
    _, counts = S.split_existing(table(spark, sf, "documents").select("doc_id"),
                                 table(spark, sf, "labels").select("doc_id"), ["doc_id"])
    return counts


@query("snk_6_write_metrics", """select conv_id, turn, array_to_string(string_split(text, ' '), ', ') as extracted from conversations""")
def _(spark, sf):
    words = F.split("text", " ")
    answers = table(spark, sf, "conversations").select("conv_id", "turn", words.alias("extracted"), words.alias("ground_truth"))
    return S.metrics_export(answers).select("conv_id", "turn", "extracted")


@query("snk_7_result_layout", """select case when c_nationkey % 5 = 0 then 'default' else 's' || cast(c_nationkey % 5 as varchar) end as system,
 case when c_custkey % 2 = 0 then 'explicit' else 'implicit' end as null_mode, '1_data_0_noise' as noise_ratio,
 cast(0 as integer) as n_documents, count(*) as n from customer group by all""")
def _(spark, sf):
    path = scratch_path(spark, "results")
    S.write_results(table(spark, sf, "customer").select(
        "c_custkey", F.expr("case when c_nationkey % 5 != 0 then 's' || cast(c_nationkey % 5 as string) end").alias("system"),
        F.expr("case when c_custkey % 2 = 0 then 'explicit' else 'implicit' end").alias("null_mode")), path)
    return S.stored(spark, path).groupBy(*S.RESULT_LAYOUT).agg(F.count("*").alias("n"))


@query("snk_8_mode_and_ratio_folder", """select folder, ratio, x, y, px, py, count(*) as n from (select
 case when o_orderkey % 4 = 0 then 'null_binary_explicit' when o_orderkey % 4 = 1 then 'null_explicit_binary_implicit'
 when o_orderkey % 4 = 2 then 'null_implicit_binary_explicit' else 'null_binary_implicit' end as folder,
 '1_data_' || cast(o_orderkey % 3 as varchar) || '_noise' as ratio, 1 as x, cast(o_orderkey % 3 as integer) as y,
 1 as px, cast(case when o_orderkey % 5 = 0 then 0 else o_orderkey % 3 end as integer) as py from orders) group by all""")
def _(spark, sf):
    k = F.col("o_orderkey")
    modes = table(spark, sf, "orders").select(
        k, F.when(k % 4 < 2, "explicit").otherwise("implicit").alias("nm"),
        F.when(k % 2 == 0, "explicit").otherwise("implicit").alias("bm"),
        F.when(k % 5 == 0, "1-0").otherwise(F.concat(F.lit("1:"), (k % 3).cast("string"))).alias("text"))
    named = modes.select(S.mode_folder(F.col("nm"), F.col("bm")).alias("folder"),
                         S.ratio_folder(F.lit(1), k % 3).alias("ratio"), "text")
    x, y = S.parse_ratio_folder(F.col("ratio"))
    px, py = S.parse_ratio(F.col("text"))
    return (named.select("folder", "ratio", x.alias("x"), y.alias("y"), px.alias("px"), py.alias("py"))
            .groupBy("folder", "ratio", "x", "y", "px", "py").agg(F.count("*").alias("n")))
