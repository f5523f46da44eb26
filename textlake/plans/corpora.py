"""Rendered corpora that the document queries read."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from textlake.operators.render import render_documents
from textlake.plans.banks import NATION_BANK, NOISE, ORDER_BANK, PART_BANK, customer_bank
from textlake.plans.base import table
from textlake.plans.fixtures import customer_x
from textlake.session import scratch_path


def customer_docs(spark, sf, null_mode="implicit", binary_mode="implicit", ratio=(1, 0), no_repeat=False):
    return render_documents(customer_x(spark, sf), customer_bank(null_mode, binary_mode), "c_custkey", "customer",
                            noise=NOISE, ratio=ratio, no_repeat=no_repeat)


def orders_dated(spark, sf):
    return table(spark, sf, "orders", heavy=True).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


def order_docs(spark, sf, ratio=(1, 0)):
    return render_documents(orders_dated(spark, sf), ORDER_BANK, "o_orderkey", "orders", noise=NOISE, ratio=ratio)


def nation_docs(spark, sf):
    return render_documents(table(spark, sf, "nation"), NATION_BANK, "n_nationkey", "nation")


def part_docs(spark, sf):
    return render_documents(table(spark, sf, "part", heavy=True), PART_BANK, "p_partkey", "part")


_STORED: dict[tuple, str] = {}


def stored(spark, sf, render, **kw):
    """A corpus at rest: rendered to the shared folder once per session, then read.

    Only the text is stored, so document queries see what a reader of the files sees.
    """
    key = (spark.sparkContext.applicationId, sf, render.__name__, *sorted(kw.items()))
    if key in _STORED:
        try:
            return spark.read.parquet(_STORED[key])
        except AnalysisException:
            pass
    path = scratch_path(spark, render.__name__)
    render(spark, sf, **kw).select("row_id", "filename", "contents").write.parquet(path)
    _STORED[key] = path
    return spark.read.parquet(path)


ORDERS_DATED = """select o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate,
 o_orderpriority from orders"""
