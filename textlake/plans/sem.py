"""Queries over documents (SEM) and post-operators (POST).

Each answer over rendered documents must equal plain SQL over the source tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.operators import post as P
from textlake.operators import semantic as S
from textlake.operators.bank import Template, bank_from_df, bank_to_df
from textlake.operators.model import RuleModel
from textlake.plans.banks import NATION_BANK, NOISE, ORDER_BANK, customer_bank
from textlake.plans.base import query, table
from textlake.plans.corpora import ORDERS_DATED, customer_docs, nation_docs, order_docs, stored
from textlake.operators.render import render_documents
from textlake.plans.fixtures import CUSTOMER_X, customer_x, duck
from textlake.plans.txt import STEPS_SQL, step_text_sql, steps, with_step_text
from textlake.session import scratch_path
from textlake.sources.readers import read_bank, read_tags
from textlake.sources.sinks import write_bank

CX = duck(CUSTOMER_X)
DEC = "cast(sum(cast({} as decimal(18,2))) as double)"
_TYPES = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_mktsegment": "string",
          "c_acctbal": "double", "is_debtor": "int", "channel": "string", "opted_in": "int"}
_ORDER_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
                "o_orderdate": "string", "o_orderpriority": "string"}


def customers(spark, sf, *fields, **kw):
    """Customer documents with the named fields read back."""
    nm, bm = kw.get("null_mode", "implicit"), kw.get("binary_mode", "implicit")
    return S.sem_extract(stored(spark, sf, customer_docs, **kw), customer_bank(nm, bm), {f: _TYPES[f] for f in fields}, plain_values=True)


def orders(spark, sf, *fields, **kw):
    return S.sem_extract(stored(spark, sf, order_docs, **kw), ORDER_BANK, {f: _ORDER_TYPES[f] for f in fields}, plain_values=True)


def nations(spark, sf):
    return S.sem_extract(stored(spark, sf, nation_docs), NATION_BANK,
                         {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}, plain_values=True)


@query("sem_0_segment_balance", f"""select c_mktsegment, {DEC.format('c_acctbal')} as balance, count(*) as n
 from customer where c_acctbal > 100 group by c_mktsegment""")
def _(spark, sf):
    docs = customers(spark, sf, "c_mktsegment", "c_acctbal")
    rich = S.sem_filter(docs, F.col("c_acctbal") > 100)
    return S.sem_agg(rich, {"balance": ("sum", "c_acctbal"), "n": ("count", "*")}, ["c_mktsegment"])


def _extract_query(nm, bm, ratio):
    cols = ", ".join(_TYPES)

    def run(spark, sf):
        docs = customers(spark, sf, *_TYPES, null_mode=nm, binary_mode=bm, ratio=ratio)
        return docs.select("row_id", *_TYPES)
    query(f"sem_1_extract_{nm}_null_{bm}_binary_{ratio[0]}_{ratio[1]}",
          f"select c_custkey as row_id, {cols} from ({CX})")(run)


for _nm in ("explicit", "implicit"):
    for _bm in ("explicit", "implicit"):
        for _r in ((1, 0), (1, 1), (1, 2)):
            _extract_query(_nm, _bm, _r)


@query("sem_1_extract_orders", f"select o_orderkey as row_id, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from ({ORDERS_DATED})")
def _(spark, sf):
    return orders(spark, sf, "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority").drop("filename", "contents")


@query("sem_1_extraction_conflicts", "select count(*) - (select count(*) from customer) as conflicts, count(*) as n_docs from customer")
def _(spark, sf):
    docs = stored(spark, sf, customer_docs)
    bad = S.extraction_conflicts(docs, customer_bank(), NOISE).agg(F.count("*").alias("n"))
    return docs.agg(F.count("*").alias("n_docs")).select(bad.scalar().alias("conflicts"), "n_docs")


# names and segments with sentence ends inside, and texts that hold a wording of an earlier slot
_AWKWARD = """select c_custkey, concat('Dr. ', c_name, ' Inc. (East)') as c_name, c_nationkey, c_acctbal, is_debtor, opted_in,
 case when c_custkey % 5 = 0 then concat(c_mktsegment, '. And more? So on') when c_custkey % 5 = 1 then concat('St. ', c_mktsegment, '! The customer on file is Mr. X')
  else c_mktsegment end as c_mktsegment,
 case when c_custkey % 7 = 0 then 'mail, e.g. letters. A balance of 7 is held' else channel end as channel from ({})"""


def _awkward_query(nm, bm, ratio):
    def run(spark, sf):
        rows = spark.sql(_AWKWARD.format("select * from {x}"), x=customer_x(spark, sf))
        bank = customer_bank(nm, bm)
        docs = render_documents(rows, bank, "c_custkey", "customer", noise=NOISE, ratio=ratio).select("row_id", "contents")
        return S.sem_extract(docs, bank, _TYPES, NOISE).select("row_id", *_TYPES)
    query(f"sem_1_extract_awkward_{nm}_null_{bm}_binary_{ratio[0]}_{ratio[1]}", f"select c_custkey as row_id, {', '.join(_TYPES)} from ({_AWKWARD.format(CX)})")(run)


for _nm, _bm, _r in (("explicit", "explicit", (1, 0)), ("explicit", "implicit", (1, 1)), ("implicit", "explicit", (1, 1)), ("implicit", "implicit", (1, 2))):
    _awkward_query(_nm, _bm, _r)


# sentences with several values, in a bank that is stored and read before anything is rendered
_SEVERAL = [
    Template("c_name", ("The customer on file is [C_NAME], number [C_CUSTKEY] in our books.", "Under number [C_CUSTKEY] we know [C_NAME] (again: [C_CUSTKEY])."), others=("c_custkey",)),
    Template("is_debtor", ("Money is owed, the balance being [C_ACCTBAL]!",), ("No money is owed; a saldo of [C_ACCTBAL] is held.",),
             variation_class="BINARY", others=("c_acctbal",), synonyms={"saldo": ("position", "balance")}),
    Template(None, ("Such notes are kept for good order.",)),
    Template("channel", ("From [C_MKTSEGMENT] in nation [C_NATIONKEY] orders come through [CHANNEL].", "Orders arrive through [CHANNEL]; the segment is [C_MKTSEGMENT], the nation [C_NATIONKEY]."),
             ("No channel is known (null) for [C_MKTSEGMENT] in nation [C_NATIONKEY].",), variation_class="NULL", others=("c_mktsegment", "c_nationkey")),
    Template("opted_in", ("Mail is welcome at this address.",), ("Mail is not welcome at this address.",), ("Nothing was said on mail.",))]


def _stored_bank(spark, bank):
    path = scratch_path(spark, "bank")
    write_bank(bank_to_df(spark, bank).select(F.lit("shop").alias("database"), F.lit("customer").alias("table"), "*"), path)
    return bank_from_df(read_bank(spark, path, multi_line=False))


def _several_query(key, source, plain):
    def run(spark, sf):
        bank, rows = _stored_bank(spark, _SEVERAL), spark.sql(source.format("select * from {x}"), x=customer_x(spark, sf))
        docs = render_documents(rows, bank, "c_custkey", "customer", noise=NOISE, ratio=(1, 1)).select("row_id", "contents")
        return S.sem_extract(docs, bank, _TYPES, None if plain else NOISE, plain).select("row_id", *_TYPES)
    query(key, f"select c_custkey as row_id, {', '.join(_TYPES)} from ({source.format(CX)})")(run)


_several_query("sem_1_extract_several_fields", _AWKWARD, False)
_several_query("sem_1_extract_several_fields_plain", "select * from ({})", True)


@query("src_7_bank_with_several_fields", """select cast(p_partkey as varchar) as "table", cast(ix as integer) as tmpl_ix, case ix when 0 then 'p_name' end as field,
 case ix when 0 then 'p_brand,p_size' else '' end as others, case ix when 0 then 'STANDARD' end as variation_class, ix = 1 as is_static, 'std' as pool, cast(vid as integer) as vid,
 case ix when 0 then case vid when 0 then '[P_NAME] by ' || p_brand || ' or [P_BRAND] at [P_SIZE].' else 'At [P_SIZE]: [P_NAME].' end else 'Part ' || cast(p_partkey as varchar) || ' is kept.' end as pattern,
 case ix when 0 then 'p_size' end as tag_field, case ix when 0 then cast(p_size as varchar) end as replacement
 from part, (values (0, 0), (0, 1), (1, 0)) v(ix, vid)""")
def _(spark, sf):
    # one bank a part, stored and read again
    part, key = table(spark, sf, "part"), F.col("p_partkey").cast("string")
    rows = part.select(F.lit("parts").alias("database"), key.alias("table"), F.expr("""inline(array(
        named_struct('pos', 0, 'field', 'p_name', 'others', array('p_brand', 'p_size'), 'variation_class', 'STANDARD', 'pool', 'std', 'vid', 0, 'pattern', '[P_NAME] by ' || p_brand || ' or [P_BRAND] at [P_SIZE].'),
        named_struct('pos', 0, 'field', 'p_name', 'others', array('p_brand', 'p_size'), 'variation_class', 'STANDARD', 'pool', 'std', 'vid', 1, 'pattern', 'At [P_SIZE]: [P_NAME].'),
        named_struct('pos', 1, 'field', cast(null as string), 'others', cast(array() as array<string>), 'variation_class', cast(null as string), 'pool', 'std', 'vid', 0,
                     'pattern', 'Part ' || p_partkey || ' is kept.')))""")).withColumn("synonyms", F.create_map(F.lit("part"), F.array(F.lit("item"))))
    tags = part.select(F.lit("parts").alias("database"), key.alias("table"), F.lit("0a1b").alias("tag"), F.lit("p_size").alias("field"),
                       F.col("p_size").cast("string").alias("replacement"))
    path = scratch_path(spark, "banks")
    write_bank(rows, path, tags)
    read = read_tags(spark, path, multi_line=False).select("table", F.lit(0).alias("tmpl_ix"), F.col("field").alias("tag_field"), "replacement")
    bank = read_bank(spark, path, multi_line=False).drop("database", "lexical_sets").withColumn("others", F.array_join("others", ","))
    return bank.join(read, ["table", "tmpl_ix"], "left")


# a segment said twice in a row: either the name or the segment may hold the other one
_TWO = [Template("c_name", ("The customer on file is [C_NAME].", "This account belongs to [C_NAME].")),
        Template("c_mktsegment", ("Trade falls under [C_MKTSEGMENT].", "Business is done in [C_MKTSEGMENT]."))]


@query("sem_1_ambiguous", "select c_custkey as row_id from customer where c_custkey % 3 = 0")
def _(spark, sf):
    doubt = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_mktsegment", F.lit(". Trade falls under "), "c_mktsegment")).otherwise(F.col("c_mktsegment"))
    docs = render_documents(customer_x(spark, sf).withColumn("c_mktsegment", doubt), _TWO, "c_custkey", "customer").select("row_id", "contents")
    return S.extraction_conflicts(docs, _TWO).where("field is null").select("row_id")


@query("sem_2_filter", f"""select c_custkey as row_id from ({CX}) where c_acctbal between 0 and 5000 and channel is null and c_name like '%8'""")
def _(spark, sf):
    docs = customers(spark, sf, "c_acctbal", "channel", "c_name")
    return S.sem_filter(docs, "c_acctbal between 0 and 5000 and channel is null and c_name like '%8'").select("row_id")


class _DebtModel(RuleModel):
    """Says yes to texts of customers in debt."""

    @staticmethod
    def _debt(contents: str) -> str:
        low = contents.lower()
        return "yes" if "customer is in debt" in low or "money is owed by" in low and "no money" not in low else "no"


@query("sem_2_filter_model", f"select c_custkey as row_id from ({CX}) where is_debtor = 1")
def _(spark, sf):
    docs = stored(spark, sf, customer_docs)
    return S.sem_filter_model(docs, F.concat_ws("\t", F.lit("debt"), "contents"), _DebtModel()).select("row_id")


@query("sem_3_map", f"select c_custkey as row_id, c_acctbal * 2 as doubled, upper(coalesce(channel, 'none')) as channel from ({CX})")
def _(spark, sf):
    docs = S.sem_map(customers(spark, sf, "c_acctbal", "channel"), "doubled", "c_acctbal * 2")
    return S.sem_map(docs, "channel", F.upper(F.coalesce("channel", F.lit("none")))).select("row_id", "doubled", "channel")


def _joined(spark, sf, how="inner"):
    return S.sem_join(customers(spark, sf, "c_custkey", "c_mktsegment"), orders(spark, sf, "o_custkey", "o_totalprice"),
                      ("c_custkey", "o_custkey"), how)


@query("sem_4_join_inner", f"""select c_mktsegment, count(*) as n, {DEC.format('o_totalprice')} as total from customer join orders on c_custkey = o_custkey group by 1""")
def _(spark, sf):
    return S.sem_agg(_joined(spark, sf), {"n": ("count", "*"), "total": ("sum", "o_totalprice")}, ["c_mktsegment"])


@query("sem_4_join_left", """select c_custkey, count(o_custkey) as n from customer left join orders on c_custkey = o_custkey group by 1""")
def _(spark, sf):
    return S.sem_agg(_joined(spark, sf, "left"), {"n": ("count", "o_custkey")}, ["c_custkey"])


@query("sem_4_join_right", """select o_custkey, count(c_custkey) as n from customer right join orders on c_custkey = o_custkey group by 1""")
def _(spark, sf):
    return S.sem_agg(_joined(spark, sf, "right"), {"n": ("count", "c_custkey")}, ["o_custkey"])


@query("sem_5_merge_joined", """select c_custkey as row_id, 'customer' || cast(c_custkey as varchar) || '.txt' as filename, o_totalprice, true as both_found
 from customer join orders on c_custkey = o_custkey""")
def _(spark, sf):
    merged = S.merge_joined(_joined(spark, sf))
    again = S.sem_extract(merged.select("row_id", "filename", "contents", F.col("o_totalprice").alias("p")),
                          ORDER_BANK, {"o_totalprice": "double"}, plain_values=True)
    return again.select("row_id", "filename", "o_totalprice",
                        (F.col("contents").contains("\n\n") & (F.col("p") == F.col("o_totalprice"))).alias("both_found"))


@query("sem_6_join_chain", """select n_name, count(*) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1""")
def _(spark, sf):
    chain = S.join_chain(orders(spark, sf, "o_custkey"), [
        (customers(spark, sf, "c_custkey", "c_nationkey"), ("o_custkey", "c_custkey"), "inner"),
        (nations(spark, sf), ("c_nationkey", "n_nationkey"), "inner")])
    return S.sem_agg(chain, {"n": ("count", "*")}, ["n_name"])


@query("sem_7_semi", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def _(spark, sf):
    big = S.sem_filter(orders(spark, sf, "o_custkey", "o_totalprice"), "o_totalprice > 400000")
    return S.sem_semi(customers(spark, sf, "c_custkey"), big, ("c_custkey", "o_custkey")).select("c_custkey")


@query("sem_7_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def _(spark, sf):
    big = S.sem_filter(orders(spark, sf, "o_custkey", "o_totalprice"), "o_totalprice > 400000")
    return S.sem_anti(customers(spark, sf, "c_custkey"), big, ("c_custkey", "o_custkey")).select("c_custkey")


@query("sem_8_agg", f"""select count(*) as n, {DEC.format('c_acctbal')} as total, {DEC.format('c_acctbal')} / count(c_acctbal) as mean, min(c_acctbal) as low,
 max(c_acctbal) as high, cast(sum(case when opted_in = 1 then 1 else 0 end) as bigint) - cast(sum(case when opted_in = 0 then 1 else 0 end) as bigint) as lead from ({CX})""")
def _(spark, sf):
    docs = customers(spark, sf, "c_acctbal", "opted_in")
    return S.sem_agg(docs, {"n": ("count", "*"), "total": ("sum", "c_acctbal"), "mean": ("avg", "c_acctbal"),
                            "low": ("min", "c_acctbal"), "high": ("max", "c_acctbal"),
                            "lead": F.count_if(F.col("opted_in") == 1) - F.count_if(F.col("opted_in") == 0)})


@query("sem_9_topk", "select o_orderkey as row_id, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def _(spark, sf):
    return S.sem_topk(orders(spark, sf, "o_totalprice"), "o_totalprice", 10).select("row_id", "o_totalprice")


@query("sem_9_top1_lowest", "select o_orderkey as row_id, o_totalprice from orders order by o_totalprice, o_orderkey limit 1")
def _(spark, sf):
    return S.sem_topk(orders(spark, sf, "o_totalprice"), "o_totalprice", 1, ascending=True).select("row_id", "o_totalprice")


@query("sem_10_cluster_by", f"""select coalesce(channel, '') || '|' || coalesce(cast(opted_in as varchar), '') as group_key, count(*) as n, max(c_acctbal) as best from ({CX}) group by 1""")
def _(spark, sf):
    grouped = S.sem_cluster_by(customers(spark, sf, "channel", "opted_in", "c_acctbal"), ["channel", "opted_in"])
    return S.sem_agg(grouped, {"n": ("count", "*"), "best": ("max", "c_acctbal")}, ["group_key"])


@query("sem_11_cluster_by_similarity")
def _(spark, sf):
    assigned, _ = S.cluster_by_similarity(table(spark, sf, "embeddings"), "embedding", 2)
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"))


_CENTROIDS = [[0.05 * ((i + c) % 5 - 2) for i in range(64)] for c in range(2)]


def _distance_sql(c: int) -> str:
    return f"list_reduce(list_concat([0.0::double], list_transform(range(1, 65), lambda i: (e[i] - {_CENTROIDS[c]}[i]) * (e[i] - {_CENTROIDS[c]}[i]))), lambda a, b: a + b)"


@query("sem_11_assign_to_centroids", f"""select vec_id, cast(case when {_distance_sql(1)} < {_distance_sql(0)} then 1 else 0 end as integer) as cluster
 from (select vec_id, embedding::double[] as e from embeddings)""")
def _(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return S.assign_to_centroids(vectors, "embedding", _CENTROIDS).select("vec_id", "cluster")


@query("sem_12_ungroup", f"select count(*) as n, count(distinct c_mktsegment) as n_groups from ({CX})")
def _(spark, sf):
    grouped = S.sem_cluster_by(customers(spark, sf, "c_mktsegment"), ["c_mktsegment"])
    return S.sem_agg(S.ungroup(grouped), {"n": ("count", "*"), "n_groups": ("count distinct", "c_mktsegment")})


@query("sem_13_dedup", "select o_custkey, min(o_orderkey) as row_id from orders group by o_custkey")
def _(spark, sf):
    docs = orders(spark, sf, "o_custkey", "o_totalprice").select("row_id", "o_custkey")
    return S.sem_dedup(docs, ["o_custkey"]).select("o_custkey", "row_id")


def _keys(spark, sf):
    a = S.sem_filter(customers(spark, sf, "c_custkey", "c_acctbal"), "c_acctbal > 2000").select(F.col("c_custkey").alias("k"))
    b = S.sem_filter(orders(spark, sf, "o_custkey", "o_totalprice"), "o_totalprice > 300000").select(F.col("o_custkey").alias("k"))
    return a, b


for _kind, _sql in (("union", "union"), ("intersect", "intersect"), ("except", "except")):
    def _setop(spark, sf, kind=_kind):
        return S.sem_setop(*_keys(spark, sf), kind)
    query(f"sem_14_{_kind}", f"select c_custkey as k from customer where c_acctbal > 2000 {_sql} select o_custkey from orders where o_totalprice > 300000")(_setop)


@query("sem_15_bind_subquery", f"select c_custkey from customer where c_acctbal > (select {DEC.format('c_acctbal')} / count(c_acctbal) from customer)")
def _(spark, sf):
    docs = customers(spark, sf, "c_custkey", "c_acctbal")
    mean = S.sem_agg(docs, {"v": ("avg", "c_acctbal")})
    return S.sem_filter(docs, F.col("c_acctbal") > S.bind_subquery(mean)).select("c_custkey")


_STEPS = [
    {"op": "subquery", "name": "$0", "steps": [{"op": "agg", "func": "avg", "field": "c_acctbal"}]},
    {"op": "filter", "table": "customer", "field": "c_acctbal", "cmp": ">", "value": "$0"},
    {"op": "filter", "table": "orders", "where": "o_orderstatus = 'F'"},
    {"op": "join", "left": "customer", "right": "orders", "on": ("c_custkey", "o_custkey")},
    {"op": "group", "keys": ["c_mktsegment"]},
    {"op": "agg", "func": "count", "field": "*"},
    {"op": "agg", "func": "max", "field": "o_totalprice"},
]


def _run_steps(spark, sf):
    return S.run_steps({"customer": customers(spark, sf, "c_custkey", "c_acctbal", "c_mktsegment"),
                        "orders": orders(spark, sf, "o_custkey", "o_orderstatus", "o_totalprice")}, _STEPS)


_STEPS_SQL = f"""with j as (select * from customer join orders on c_custkey = o_custkey where o_orderstatus = 'F' and c_acctbal >
 (select {DEC.format('c_acctbal')} / count(c_acctbal) from customer)),
 a as (select 0 as ix, c_mktsegment as group_key, cast(count(*) as varchar) as answer from j group by 2 union all
 select 1, c_mktsegment, cast(max(o_totalprice) as varchar) from j group by 2)"""


@query("sem_16_run_steps", f"{_STEPS_SQL} select cast(ix as integer) as ix, group_key, answer from a")
def _(spark, sf):
    counts, best = _run_steps(spark, sf)
    return counts.withColumn("ix", F.lit(0)).unionByName(best.withColumn("ix", F.lit(1)))


@query("sem_16_topk_in_group", """select c_mktsegment as group_key, cast(c_custkey as varchar) as answer from customer
 qualify row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) <= 3""")
def _(spark, sf):
    return S.run_steps({"customer": customers(spark, sf, "c_custkey", "c_acctbal", "c_mktsegment")},
                       [{"op": "group", "keys": ["c_mktsegment"]}, {"op": "topk", "by": "c_acctbal", "k": 3, "per": "group"},
                        {"op": "extract", "field": "c_custkey"}])[0]


@query("sem_16_filter_in_group", f"""select c_mktsegment as group_key, cast(count(*) as varchar) as answer from (select *, avg(c_acctbal) over (partition by c_mktsegment) as mean,
 count(*) over (partition by c_mktsegment) as n from customer) where c_acctbal > mean + 2000 and n > 5 group by 1""")
def _(spark, sf):
    return S.run_steps({"customer": customers(spark, sf, "c_acctbal", "c_mktsegment")},
                       [{"op": "group", "keys": ["c_mktsegment"]},
                        {"op": "filter", "per": "group", "aggs": {"mean": ("avg", "c_acctbal"), "n": ("count", "*")}, "where": "c_acctbal > mean + 2000 and n > 5"},
                        {"op": "agg", "func": "count", "field": "*"}])[0]


@query("sem_17_run_branches", """select c_mktsegment, count(*) as n, count(case when c_acctbal > 0 then 1 end) as n_positive,
 cast(sum(cast(case when c_nationkey < 10 then c_acctbal end as decimal(18,2))) as double) as near_balance from customer group by 1""")
def _(spark, sf):
    trunk = customers(spark, sf, "c_mktsegment", "c_acctbal", "c_nationkey")
    return S.run_branches(trunk, {"n": (None, "count", None), "n_positive": (F.col("c_acctbal") > 0, "count", None),
                                  "near_balance": (F.col("c_nationkey") < 10, "sum", "c_acctbal")}, ["c_mktsegment"])


@query("sem_17_run_graph", f"""with trunk as (select * from customer where c_nationkey < 20), j as (select t.*, o_totalprice from trunk t join orders on c_custkey = o_custkey where o_orderstatus = 'F'),
 v as (select c_mktsegment, cast(count(*) as double) as n, cast(count(case when c_acctbal > (select {DEC.format('c_acctbal')} / count(c_acctbal) from trunk) then 1 end) as double) as n_rich,
 (select max(o_totalprice) from j where j.c_mktsegment = t.c_mktsegment) as dearest, (select cast(count(*) as double) from j where j.c_mktsegment = t.c_mktsegment and o_totalprice > 200000) as n_dear,
 cast(count(case when c_custkey not in (select o_custkey from orders) then 1 end) as double) as n_idle from trunk t group by 1)
 select *, n_rich / n * 100 as rich_percent, n_dear > n_idle as busy from v""")
def _(spark, sf):
    join = {"op": "join", "left": "trunk", "right": "orders", "on": ("c_custkey", "o_custkey")}
    return S.run_graph(
        {"customer": customers(spark, sf, "c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment"),
         "orders": orders(spark, sf, "o_custkey", "o_orderstatus", "o_totalprice")},
        [{"op": "filter", "where": "c_nationkey < 20"}, {"op": "group", "keys": ["c_mktsegment"]}],
        {"n": [{"op": "agg", "func": "count"}],
         "n_rich": [{"op": "subquery", "name": "$0", "steps": [{"op": "agg", "func": "avg", "field": "c_acctbal"}]},
                    {"op": "filter", "field": "c_acctbal", "cmp": ">", "value": "$0"}, {"op": "agg", "func": "count"}],
         "dearest": [join, {"op": "filter", "where": "o_orderstatus = 'F'"}, {"op": "agg", "func": "max", "field": "o_totalprice"}],
         "n_dear": [{"op": "filter", "table": "orders", "where": "o_orderstatus = 'F'"}, join, {"op": "filter", "where": "o_totalprice > 200000"}, {"op": "agg", "func": "count"}],
         "n_idle": [{"op": "anti", "right": "orders", "on": ("c_custkey", "o_custkey")}, {"op": "agg", "func": "count"}]},
        {"rich_percent": lambda n_rich, n: P.percent(n_rich, n), "busy": lambda n_dear, n_idle: n_dear > n_idle})


@query("sem_18_collect_answers", f"{_STEPS_SQL} select string_agg(answer, ';' order by ix, group_key, answer) as answers from a")
def _(spark, sf):
    return S.collect_answers(_run_steps(spark, sf)).select(F.array_join("answers", ";").alias("answers"))


_ABLE = ["sem_filter", "sem_join", "sem_agg", "sem_extract"]


def _capabilities(spark):
    return spark.createDataFrame([("full", t) for t in (*_ABLE, "sem_topk", "sem_cluster_by")]
                                 + [("small", t) for t in _ABLE], "backend string, op_type string")


@query("sem_19_supported_steps", f"""select question_id, bool_and(op_type in ({", ".join(f"'{t}'" for t in _ABLE)})) as kept from ({STEPS_SQL}) group by 1 having kept""")
def _(spark, sf):
    kept, _ = S.supported_steps(steps(spark, sf), _capabilities(spark), "small")
    return kept.withColumn("kept", F.lit(True))


@query("sem_20_nl_steps", f"""select question_id, op_index, count(*) as n, min(case when question_id % 10 = 0 then 'stored' else i end) as instruction from
 (select *, {step_text_sql()} as i from ({STEPS_SQL})) group by 1, 2""")
def _(spark, sf):
    st = with_step_text(steps(spark, sf))
    cache = st.where(F.col("question_id") % 10 == 0).select("question_id", "op_index").distinct().withColumn(
        "instruction", F.lit("stored"))
    worded = S.nl_steps(st.withColumnRenamed("instruction", "_w"), F.col("_w"), cache)
    return worded.groupBy("question_id", "op_index").agg(F.count("*").alias("n"), F.min("instruction").alias("instruction"))


# --- post-operators ------------------------------------------------------------------

def _branches(spark, sf):
    """Two branches per nation over the customer documents: customers in credit and in debt."""
    docs = customers(spark, sf, "c_nationkey", "c_acctbal")
    good, bad = F.col("c_acctbal") >= 0, F.col("c_acctbal") < 0
    b = S.run_branches(docs, {"v0": (good, "count", None), "v1": (bad, "count", None), "s0": (good, "sum", "c_acctbal"),
                              "all_rows": (None, "count", None), "s_all": (None, "sum", "c_acctbal")}, ["c_nationkey"])
    return b.withColumns({c: F.col(c).cast("double") for c in ("v0", "v1", "all_rows")})


_B = f"""(select c_nationkey, cast(count(*) filter (where c_acctbal >= 0) as double) as v0, cast(count(*) filter (where c_acctbal < 0) as double) as v1,
 cast(sum(cast(c_acctbal as decimal(18,2))) filter (where c_acctbal >= 0) as double) as s0, cast(count(*) as double) as all_rows,
 {DEC.format('c_acctbal')} as s_all from customer group by 1)"""
_T = "cast({} as varchar)"


def _post(key, sql, fn):
    query(key, f"select c_nationkey, {sql} as answer from {_B}")(
        lambda spark, sf: _branches(spark, sf).select("c_nationkey", fn(*[F.col(c) for c in (
            "v0", "v1", "s0", "all_rows", "s_all")]).alias("answer")))


_post("post_1_total", "cast(cast(all_rows as bigint) as varchar)", lambda v0, v1, s0, n, s: P.total(n.cast("bigint")))
_post("post_2_ratio", "case when v1 = 0 then 'None' else " + _T.format("v0") + " || ' / ' || " + _T.format("v1") + " end",
      lambda v0, v1, s0, n, s: P.ratio(v0, v1))
_post("post_2_ratio_value", "v0 / nullif(v1, 0)", lambda v0, v1, s0, n, s: P.ratio_value(v0, v1))
_post("post_3_difference", "v0 - v1", lambda v0, v1, s0, n, s: P.difference(v0, v1))
_post("post_4_greater", "case when v0 > v1 * 10 then 'True' else 'False' end", lambda v0, v1, s0, n, s: P.greater(v0, v1 * 10))
_post("post_4_less", "case when v0 < v1 * 10 then 'True' else 'False' end", lambda v0, v1, s0, n, s: P.less(v0, v1 * 10))
_post("post_5_bool", "case when v1 > 0 then 'True' else 'False' end", lambda v0, v1, s0, n, s: P.has_documents(v1))
_post("post_6_percent_count", "case when v1 <> 0 and all_rows <> 0 then v1 / all_rows * 100 end",
      lambda v0, v1, s0, n, s: P.percent_of_count(v1, n))
_post("post_7_percent_sum", "case when s0 <> 0 and s_all <> 0 then s0 / s_all * 100 end",
      lambda v0, v1, s0, n, s: P.percent_of_sum(s0, s))
_post("post_8_percent", "v0 / nullif(v1, 0) * 100", lambda v0, v1, s0, n, s: P.percent(v0, v1))
_post("post_9_percent_reverse", "case when v0 <> 0 and v1 <> 0 then v1 / v0 * 100 end",
      lambda v0, v1, s0, n, s: P.percent_nonzero(v1, v0))
_post("post_10_total_percent", "v0 / nullif(all_rows, 0) * 100", lambda v0, v1, s0, n, s: P.total_percent(v0, n))
_post("post_11_composite", "case when v0 > v1 then 'True' else 'False' end || ';' || cast(v0 - v1 as varchar) || ';' || cast(v0 as varchar)",
      lambda v0, v1, s0, n, s: F.array_join(P.apply_list(">,-, total, unknown", v0, v1), ";"))


@query("post_12_fallback_value", """select c_custkey, case when c_custkey % 4 = 0 then 'op' when c_custkey % 4 = 1 then cast(c_custkey as varchar)
 when c_custkey % 4 = 2 then c_mktsegment else 'None' end as answer from customer""")
def _(spark, sf):
    k = F.col("c_custkey")
    docs = customers(spark, sf, "c_custkey", "c_mktsegment")
    answers = F.when(k % 4 == 0, F.array(F.lit("op"))).otherwise(F.array().cast("array<string>"))
    return docs.select(k, F.array_join(P.fallback_value(
        answers, F.when(k % 4 == 1, k), F.when(k % 4 == 2, F.col("c_mktsegment")), k % 4 == 3), ";").alias("answer"))


_Q = """case conv_id % 8 when 0 then 'What percent of items is sold?' when 1 then 'What is the ratio of A to B?' when 2 then 'What is the difference of sums?'
 when 3 then 'Are there more than 5, higher than B?' when 4 then 'Is it sold?' when 5 then 'How many items are there?' when 6 then 'Is A less than B?' else 'Name the item.' end"""


@query("post_13_choose_post_op", f"""select conv_id, case when contains(q, 'percent') and s and two then 'percent sum' when contains(q, 'percent') and two then 'percent' when contains(q, 'percent') and c then 'percent count'
 when contains(q, 'ratio') and two then 'ratio' when regexp_matches(q, 'difference|how many more|how much more') and two then '-'
 when regexp_matches(q, 'more than|higher than|greater than') and two then '>' when regexp_matches(q, 'less than|lower than|fewer than') and two then '<'
 when regexp_matches(q, '^(is|are|was|were|does|do|did|has|have)\\b') then 'bool' when regexp_matches(q, 'how many|number of') and not c then 'total' end as post_op
 from (select conv_id, lower({_Q}) as q, count(*) >= 3 as two, bool_or(role = 'system') as s, count(*) % 2 = 0 as c from conversations group by conv_id)""")
def _(spark, sf):
    q = (table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.when(F.count("*") >= 3, 2).otherwise(1).alias("nb"), F.bool_or(F.col("role") == "system").alias("s"),
        (F.count("*") % 2 == 0).alias("c")))
    return q.select("conv_id", P.choose_post_op(F.expr(_Q), F.col("nb"), F.col("s"), F.col("c")).alias("post_op"))
