"""Relational operators of gold queries (REL), as Spark built-ins over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.operators.ordering import neighbours, number_rows, rank_values
from textlake.plans.base import query, table

DEC = "cast(sum(cast({} as decimal(18,2))) as double)"


def _sum(c):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


@query("rel_1_scan_project", "select o_orderkey, o_totalprice from orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice")


@query("rel_2_comparisons", """select count(*) filter (where l_quantity = 10) as eq, count(*) filter (where l_quantity <> 10) as ne, count(*) filter (where l_quantity < 10) as lt,
 count(*) filter (where l_quantity <= 10) as le, count(*) filter (where l_quantity > 10) as gt, count(*) filter (where l_quantity >= 10) as ge from lineitem""")
def _(spark, sf):
    q = F.col("l_quantity")
    tests = {"eq": q == 10, "ne": q != 10, "lt": q < 10, "le": q <= 10, "gt": q > 10, "ge": q >= 10}
    return table(spark, sf, "lineitem").agg(*[F.count_if(t).alias(n) for n, t in tests.items()])


@query("rel_3_between", "select count(*) filter (where l_quantity between 5 and 10) as inside, count(*) filter (where l_quantity not between 5 and 10) as outside from lineitem")
def _(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").agg(F.count_if(q.between(5, 10)).alias("inside"), F.count_if(~q.between(5, 10)).alias("outside"))


@query("rel_4_like", "select p_partkey, p_name from part where p_name like '%ring%' and p_name not like 'red%' and p_brand ilike 'BRAND#1%'")
def _(spark, sf):
    return table(spark, sf, "part").where(F.col("p_name").like("%ring%") & ~F.col("p_name").like("red%")
                                          & F.col("p_brand").ilike("BRAND#1%")).select("p_partkey", "p_name")


@query("rel_5_in_list", "select o_orderkey from orders where o_orderstatus in ('F', 'P') and o_orderpriority not in ('5-LOW', '1-URGENT')")
def _(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "P")
                                            & ~F.col("o_orderpriority").isin("5-LOW", "1-URGENT")).select("o_orderkey")


@query("rel_6_is_null", "select count(*) filter (where v is null) as missing, count(*) filter (where v is not null) as present from (select nullif(o_orderstatus, 'F') as v from orders)")
def _(spark, sf):
    v = F.nullif(F.col("o_orderstatus"), F.lit("F"))
    return table(spark, sf, "orders").agg(F.count_if(v.isNull()).alias("missing"), F.count_if(v.isNotNull()).alias("present"))


@query("rel_7_and_or", "select c_custkey from customer where (c_acctbal > 5000 and c_mktsegment = 'BUILDING') or (c_acctbal < 0 and c_nationkey < 5)")
def _(spark, sf):
    b, s, n = F.col("c_acctbal"), F.col("c_mktsegment"), F.col("c_nationkey")
    return table(spark, sf, "customer").where(((b > 5000) & (s == "BUILDING")) | ((b < 0) & (n < 5))).select("c_custkey")


@query("rel_8_inner_join", f"""select n_name, count(*) as n, {DEC.format('o_totalprice')} as total from orders join customer on o_custkey = c_custkey
 join nation on c_nationkey = n_nationkey group by n_name""")
def _(spark, sf):
    # orders are summed per customer first, so a hot customer moves as one row
    per_customer = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("t"))
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return (per_customer.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy("n_name").agg(F.sum("n").alias("n"), F.sum("t").cast("double").alias("total")))


@query("rel_9_outer_joins", """select 'left' as side, count(*) as n, count(o_orderkey) as matched from customer left join (select * from orders where o_totalprice > 450000) on c_custkey = o_custkey
 union all select 'right', count(*), count(c_custkey) from (select * from customer where c_acctbal > 5000) right join orders on c_custkey = o_custkey""")
def _(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    left = c.join(o.where("o_totalprice > 450000"), on, "left").agg(F.count("*").alias("n"), F.count("o_orderkey").alias("matched"))
    right = c.where("c_acctbal > 5000").join(o, on, "right").agg(F.count("*").alias("n"), F.count("c_custkey").alias("matched"))
    return left.select(F.lit("left").alias("side"), "n", "matched").union(right.select(F.lit("right"), "n", "matched"))


@query("rel_10_theta_residual", """select count(*) as n from lineitem join part on l_partkey = p_partkey where l_extendedprice > 40 * p_retailprice and l_quantity < p_size""")
def _(spark, sf):
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    on = (F.col("l_partkey") == F.col("p_partkey")) & (F.col("l_extendedprice") > 40 * F.col("p_retailprice")) & (
        F.col("l_quantity") < F.col("p_size"))
    return li.join(p, on).agg(F.count("*").alias("n"))


@query("rel_11_semi_anti", """select 'semi' as kind, count(*) as n from supplier where exists (select 1 from lineitem where l_suppkey = s_suppkey and l_discount > 0.09 and l_quantity > 49)
 union all select 'anti', count(*) from supplier where not exists (select 1 from lineitem where l_suppkey = s_suppkey and l_discount > 0.09 and l_quantity > 49)""")
def _(spark, sf):
    s = table(spark, sf, "supplier")
    hit = table(spark, sf, "lineitem").where("l_discount > 0.09 and l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return s.join(hit, "s_suppkey", "left_semi").agg(F.count("*").alias("n")).select(F.lit("semi").alias("kind"), "n").union(
        s.join(hit, "s_suppkey", "left_anti").agg(F.count("*").alias("n")).select(F.lit("anti"), "n"))


@query("rel_12_group_by", f"select l_returnflag, l_linestatus, count(*) as n, {DEC.format('l_quantity')} as qty from lineitem group by 1, 2")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), _sum("l_quantity").alias("qty"))


@query("rel_13_distinct", "select distinct o_orderstatus, o_orderpriority from orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("rel_14_having", "select o_custkey, count(*) as n from orders group by 1 having count(*) > 15")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 15")


@query("rel_15_aggregates", f"""select l_returnflag, count(*) as n, count(distinct l_suppkey) as suppliers, {DEC.format('l_extendedprice')} as total, {DEC.format('l_extendedprice')} / count(*) as mean,
 min(l_extendedprice) as low, max(l_extendedprice) as high from lineitem group by 1""")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), _sum("l_extendedprice").alias("total"),
        (_sum("l_extendedprice") / F.count("*")).alias("mean"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


_STATS = {"stddev_pop": 1, "stddev_samp": 1, "var_pop": 1, "var_samp": 1, "covar_pop": 2, "covar_samp": 2, "corr": 2,
          "regr_slope": 2, "regr_intercept": 2, "regr_r2": 2, "regr_count": 2}


@query("rel_16_statistics", "select l_returnflag, " + ", ".join(
    (f"cast({f}(l_quantity, l_discount) as bigint) as {f}" if f == "regr_count" else f"round({f}({'l_quantity' if n == 1 else 'l_quantity, l_discount'}), 6) as {f}")
    for f, n in _STATS.items()) + " from lineitem group by 1")
def _(spark, sf):
    q, d = F.col("l_quantity"), F.col("l_discount")
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(*[
        (F.regr_count(q, d) if f == "regr_count" else F.round(getattr(F, f)(q) if n == 1 else getattr(F, f)(q, d), 6)).alias(f)
        for f, n in _STATS.items()])


@query("rel_17_bool_bit", """select o_orderstatus, bool_and(o_totalprice > 0) as all_paid, bool_or(o_totalprice > 499000) as any_big, bit_and(o_custkey) as b_and, bit_or(o_custkey) as b_or from orders group by 1""")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.every(F.col("o_totalprice") > 0).alias("all_paid"), F.bool_or(F.col("o_totalprice") > 499000).alias("any_big"),
        F.bit_and("o_custkey").alias("b_and"), F.bit_or("o_custkey").alias("b_or"))


@query("rel_18_collections", """select l_orderkey, array_to_string(list(cast(l_partkey as varchar) order by l_linenumber, l_partkey), ',') as parts, string_agg(l_returnflag, '' order by l_linenumber, l_partkey, l_returnflag) as flags,
 '[' || string_agg('{"line":' || cast(l_linenumber as varchar) || ',"part":' || cast(l_partkey as varchar) || '}', ',' order by l_linenumber, l_partkey) || ']' as doc from lineitem group by 1""")
def _(spark, sf):
    # the group is an order: its lines are few
    lines = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"))))
    return (table(spark, sf, "lineitem").groupBy("l_orderkey").agg(lines.alias("x"))
            .select("l_orderkey", F.array_join(F.transform("x", lambda r: r["part"].cast("string")), ",").alias("parts"),
                    F.array_join(F.transform("x", lambda r: r["flag"]), "").alias("flags"),
                    F.to_json(F.transform("x", lambda r: F.struct(r["line"].alias("line"), r["part"].alias("part")))).alias("doc")))


@query("rel_19_mode_percentile", """with c as (select l_returnflag, l_quantity, count(*) as n from lineitem group by 1, 2), m as (select l_returnflag, arg_max(l_quantity, n * 1000 - l_quantity) as common from c group by 1)
 select l_returnflag, common, percentile_cont(0.5) within group (order by l_quantity) as med, percentile_disc(0.9) within group (order by l_quantity) as p90 from lineitem join m using (l_returnflag) group by 1, 2""")
def _(spark, sf):
    # exact quantiles keep one counter per distinct value; quantities have fifty
    li = table(spark, sf, "lineitem")
    common = li.groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("n")).groupBy("l_returnflag").agg(
        F.max_by("l_quantity", F.struct("n", -F.col("l_quantity"))).alias("common"))
    q = li.groupBy("l_returnflag").agg(
        F.expr("percentile_cont(0.5) within group (order by l_quantity)").alias("med"),
        F.expr("percentile_disc(0.9) within group (order by l_quantity)").alias("p90"))
    return common.join(q, "l_returnflag")


@query("rel_20_ranking", """select o_orderkey, rank() over w as rank, dense_rank() over w as dense_rank, percent_rank() over w as percent_rank, cume_dist() over w as cume_dist
 from orders window w as (partition by o_orderpriority order by o_custkey)""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    return rank_values(o, ["o_orderpriority"], "o_custkey").drop("o_orderpriority", "o_custkey")


@query("rel_20_row_number", "select o_orderkey, row_number() over (partition by o_orderpriority order by o_orderkey) as rn from orders")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return number_rows(o, "o_orderkey", ["o_orderpriority"]).drop("o_orderpriority")


@query("rel_21_lag_lead", """select event_id, lag(value) over w as prev_value, lead(value) over w as next_value from events window w as (partition by event_type order by event_id)""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    return neighbours(e, ["event_type"], "event_id", "value").drop("event_type", "value")


@query("rel_21_first_last_nth", """select distinct event_type, first_value(value) over w as first, last_value(value) over w as last, nth_value(value, 2) over w as second from events
 window w as (partition by event_type order by event_id rows between unbounded preceding and unbounded following)""")
def _(spark, sf):
    # the frame is the whole group, so each value is an aggregate and no group is sorted
    e = table(spark, sf, "events")
    ends = e.groupBy("event_type").agg(F.min_by("value", "event_id").alias("first"), F.max_by("value", "event_id").alias("last"),
                                       F.min("event_id").alias("_f"))
    rest = e.join(ends.select("event_type", "_f"), "event_type").where("event_id > _f")
    second = rest.groupBy("event_type").agg(F.min_by("value", "event_id").alias("second"))
    return ends.drop("_f").join(second, "event_type", "left")


@query("rel_22_conditional_aggregates", """select o_orderpriority, cast(sum(case when o_orderstatus = 'F' then 1 else 0 end) as bigint) as f_count, cast(sum(case when o_orderstatus = 'O' then cast(o_totalprice as decimal(18,2)) else 0 end) as double) as o_total,
 count(*) filter (where o_totalprice > 200000) as big from orders group by 1""")
def _(spark, sf):
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.sum(F.when(s == "F", 1).otherwise(0)).alias("f_count"),
        F.sum(F.when(s == "O", F.col("o_totalprice").cast("decimal(18,2)")).otherwise(0)).cast("double").alias("o_total"),
        F.count_if(F.col("o_totalprice") > 200000).alias("big"))


@query("rel_23_aggregate_arithmetic", """select o_orderpriority, count(*) filter (where o_orderstatus = 'F') - count(*) filter (where o_orderstatus = 'O') as lead,
 cast(count(*) filter (where o_orderstatus = 'F') as double) / nullif(count(*) filter (where o_orderstatus = 'O'), 0) as ratio, cast(count(*) filter (where o_orderstatus = 'F') as double) * 100 / nullif(count(*), 0) as percent from orders group by 1""")
def _(spark, sf):
    f, o = F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") == "O")
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        (f - o).alias("lead"), F.try_divide(f.cast("double"), o.cast("double")).alias("ratio"),
        F.try_divide(f.cast("double") * 100, F.count("*").cast("double")).alias("percent"))


@query("rel_24_order_limit", "select o_orderkey, nullif(o_orderstatus, 'F') as s from orders order by nullif(o_orderstatus, 'F') nulls first, o_totalprice desc, o_orderkey limit 20")
def _(spark, sf):
    s = F.nullif(F.col("o_orderstatus"), F.lit("F"))
    return (table(spark, sf, "orders").withColumn("s", s)
            .orderBy(F.col("s").asc_nulls_first(), F.col("o_totalprice").desc(), "o_orderkey").limit(20).select("o_orderkey", "s"))


@query("rel_25_subqueries", f"""select c_custkey from customer c where c_acctbal > (select {DEC.format('c_acctbal')} / count(*) from customer d where d.c_nationkey = c.c_nationkey)
 and c_custkey in (select o_custkey from orders where o_totalprice > 300000) and (select count(*) from orders) > 10""")
def _(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    means = c.groupBy("c_nationkey").agg((_sum("c_acctbal") / F.count("*")).alias("m"))
    return (c.join(means, "c_nationkey").where(F.col("c_acctbal") > F.col("m"))
            .join(o.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
            .where(o.agg(F.count("*")).scalar() > 10).select("c_custkey"))


@query("rel_26_cte", f"with t as (select o_custkey, {DEC.format('o_totalprice')} as total from orders group by 1) select c_mktsegment, max(total) as best from t join customer on o_custkey = c_custkey group by 1")
def _(spark, sf):
    t = table(spark, sf, "orders").groupBy("o_custkey").agg(_sum("o_totalprice").alias("total"))
    return t.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.max("total").alias("best"))


@query("rel_27_set_operations", """select 'union' as kind, count(*) as n from (select c_nationkey from customer union select s_nationkey from supplier) union all
 select 'intersect', count(*) from (select c_custkey from customer intersect select o_custkey from orders) union all select 'except', count(*) from (select c_custkey from customer except select o_custkey from orders)""")
def _(spark, sf):
    c, s, o = table(spark, sf, "customer"), table(spark, sf, "supplier"), table(spark, sf, "orders")
    keys, used = c.select("c_custkey"), o.select("o_custkey")
    sets = {"union": c.select("c_nationkey").union(s.select("s_nationkey")).distinct(), "intersect": keys.intersect(used),
            "except": keys.subtract(used)}
    parts = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, d in sets.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("rel_28_date_text_scalars", """select o_orderkey, cast(year(o_orderdate) as integer) as y, strftime(o_orderdate, '%Y-%m') as ym, substr(o_orderpriority, 3) as word, try_cast(substr(o_orderpriority, 1, 1) as integer) as level,
 cast(date_diff('day', o_orderdate::date, date '2024-01-01') as integer) as age_days from orders""")
def _(spark, sf):
    d, p = F.col("o_orderdate"), F.col("o_orderpriority")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.year(d).alias("y"), F.date_format(d, "yyyy-MM").alias("ym"), F.substring(p, 3, 100).alias("word"),
        F.substring(p, 1, 1).try_cast("int").alias("level"), F.datediff(F.lit("2024-01-01").cast("date"), d).alias("age_days"))


@query("rel_29_table_heads", """select count(*) as n from (select * from customer order by c_custkey limit 500) join (select * from orders order by o_orderkey limit 5000) on c_custkey = o_custkey""")
def _(spark, sf):
    from textlake.operators.evaluate import head_tables
    heads = head_tables({"customer": (table(spark, sf, "customer"), "c_custkey"), "orders": (table(spark, sf, "orders"), "o_orderkey")}, 500)
    heads["orders"] = table(spark, sf, "orders").orderBy("o_orderkey").limit(5000)
    return spark.sql("select count(*) as n from {customer} join {orders} on c_custkey = o_custkey", **heads)


@query("rel_30_several_answers", f"""with a as (select count(*) as n, max(c_acctbal) as best, {DEC.format('c_acctbal')} as total from customer)
 select 'n' as item, cast(n as double) as answer from a union all select 'best', best from a union all select 'total', total from a""")
def _(spark, sf):
    one = table(spark, sf, "customer").agg(F.count("*").cast("double").alias("n"), F.max("c_acctbal").alias("best"), _sum("c_acctbal").alias("total"))
    return one.select(F.expr("stack(3, 'n', n, 'best', best, 'total', total) as (item, answer)"))
