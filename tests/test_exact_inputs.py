"""Inputs on which sums, joins, groups and caches once lost or changed data."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.operators import cost, evaluate, generate, semantic
from textlake.operators.model import RuleModel, model_map
from textlake.session import scratch_path
from textlake.sources import readers, sinks


def one(df):
    return [tuple(r) for r in df.collect()]


def test_sums_keep_small_and_large_values(spark):
    small = spark.createDataFrame([(0.125,), (0.004,), (0.004,), (None,)], "x double")
    total, mean = one(semantic.sem_agg(small, {"s": ("sum", "x"), "a": ("avg", "x")}))[0]
    assert total == 0.133 and abs(mean - 0.133 / 3) < 1e-12
    large = spark.createDataFrame([(1e17,), (1e30,), (float("inf"),)], "x double")
    assert one(semantic.sem_agg(large.where("x < 1e18"), {"s": ("sum", "x")})) == [(1e17,)]
    assert one(semantic.sem_agg(large.where("x < 1e31"), {"s": ("sum", "x")})) == [(1e30 + 1e17,)]
    assert one(semantic.sem_agg(large, {"s": ("sum", "x")})) == [(float("inf"),)]
    assert one(semantic.sem_agg(large.limit(0), {"s": ("sum", "x")})) == [(None,)]


def test_small_costs_are_kept(spark):
    stats = spark.createDataFrame([("q", 1, "p", 0.5, 0.0012, 3), ("q", 2, "p", 0.25, 0.0031, 4)],
                                  "q string, op_id int, path string, seconds double, cost double, tokens long")
    assert one(cost.op_cost_dedup(stats, ["q"]).select("seconds", "cost", "tokens")) == [(0.75, 0.0043, 7)]


def test_join_keeps_both_sides_of_a_shared_name(spark):
    left = spark.createDataFrame([("l1", 7, "L", "left text")], "row_id string, k int, note string, contents string")
    right = spark.createDataFrame([("r1", 7, "R", "right text", "kept")], "row_id string, k2 int, note string, contents string, go_right string")
    joined = semantic.merge_joined(semantic.sem_join(left, right, ("k", "k2")))
    assert one(joined.select("row_id", "right_row_id", "note", "right_note", "go_right", "contents")) == [
        ("l1", "r1", "L", "R", "kept", "left text\n\nright text")]
    third = semantic.join_chain(left, [(right, ("k", "k2"), "inner"), (right.withColumnRenamed("k2", "k3"), ("k", "k3"), "inner")])
    assert {"note", "right_note", "right_right_note"} <= set(third.columns)


def test_group_keys_do_not_collide(spark):
    docs = spark.createDataFrame([("a|", "b"), ("a", "|b"), ("a", None), ("a", ""), (None, "a")], "x string, y string")
    assert semantic.sem_cluster_by(docs, ["x", "y"]).select("group_key").distinct().count() == 5
    counted = semantic.run_steps({"d": docs}, [{"op": "group", "keys": ["x", "y"]}, {"op": "agg", "func": "count"}])[0]
    assert sorted(one(counted.select("answer"))) == [("1",)] * 5


def test_steps_on_groups_lists_and_set_operations(spark):
    docs = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 5), (4, "b", 6), (5, "b", 7), (6, "c", 9), (7, None, 9)], "row_id int, g string, v int")
    other = spark.createDataFrame([("a",), ("z",)], "g string")
    tables = {"d": docs, "o": other}
    agg = {"op": "agg", "func": "count"}
    top = semantic.run_steps(tables, [{"op": "group", "keys": ["g"]}, agg | {"having": "value > 1", "order": [("value", "desc")], "limit": 1}])[0]
    assert one(top) == [("b", "3")]
    some = {"op": "subquery", "name": "$0", "many": True, "type": "string", "steps": [{"op": "filter", "where": "v > 5"}, {"op": "extract", "field": "g"}]}
    assert one(semantic.run_steps(tables, [some, {"op": "filter", "field": "g", "in": "$0"}, agg])[0]) == [("", "4")]
    assert one(semantic.run_steps(tables, [{"op": "setop", "kind": "except", "fields": ["g"], "right": "o"}, agg])[0]) == [("", "3")]
    first = semantic.sem_topk(docs, [("v", "desc"), ("g", "asc", "first")], 1)
    assert one(first.select("row_id")) == [(7,)]
    assert one(semantic.sem_topk(docs.drop("row_id"), "v", 1, True)) == [("a", 1)]
    try:
        semantic.run_steps(tables, [{"op": "sorted"}])
    except ValueError:
        return
    raise AssertionError("an unknown step must raise")


def test_stored_answers_are_asked_once(spark):
    path = scratch_path(spark, "answers")
    for n in (1, 2, 3):
        rows = spark.createDataFrame([(i, f"echo\tw{i}") for i in range(n)], "i int, p string")
        assert sorted(one(model_map(rows, "p", RuleModel(), cache_path=path).select("i", "answer"))) == [(i, f"w{i}") for i in range(n)]
    assert spark.read.option("recursiveFileLookup", True).parquet(path).count() == 3


def test_sentences_without_wording_stay(spark):
    rows = spark.createDataFrame([("The part is here.",)], "sentence string")
    assert one(generate.expand_variations(rows, 2, RuleModel(), null_phrases=["unheard of"])) == [("The part is here.", None, None)]


def test_repeated_keys_and_rows(spark):
    rows = spark.createDataFrame([("a: 1\nb: 2\na: 3",)], "t string")
    assert rows.select(readers.parse_kv(F.col("t")).alias("m")).first().m == {"a": "3", "b": "2"}
    pair = spark.createDataFrame([("x", None), ("x", None)], "a string, b string")
    hashes = {one(d.agg(evaluate.content_hash(d, ["a", "b"])))[0][0] for d in (pair, pair.limit(1), pair.limit(0), pair.select("b", F.col("a")).toDF("a", "b"))}
    assert len(hashes) == 4
    long = spark.createDataFrame([(["y" * 600], ["z"])], "extracted array<string>, ground_truth array<string>")
    assert len(sinks.metrics_export(long).first().extracted) == 600
    said = spark.createDataFrame([("r", "f", "second", 2), ("r", "f", "first", 1)], "row_id string, field string, sentence string, pos int")
    assert sinks.to_multi_column(said, ["f"]).first().f == "first"


def test_steps_inside_groups(spark):
    """Hot and NULL groups, ties, and clashing names."""
    from textlake.operators import semantic as S
    data = [(i, None if i % 5 == 0 else "hot" if i % 3 else "cold", float(i % 7), i) for i in range(300)]
    docs = spark.createDataFrame(data, "row_id int, g string, v double, _place int")
    got = sorted((str(r["g"]), r["row_id"]) for r in S.sem_topk_in(docs, ["g"], "v", 4).collect())
    want = []
    for g in (None, "hot", "cold"):
        want += [(str(g), r[0]) for r in sorted((d for d in data if d[1] == g), key=lambda d: (-d[2], d[0]))[:4]]
    assert got == sorted(want)
    kept = S.sem_filter_in(docs, ["g"], {"top": ("max", "v"), "n": ("count", "*")}, "v = top and n < 100")
    assert kept.columns == docs.columns
    small = [g for g in (None, "hot", "cold") if sum(d[1] == g for d in data) < 100]
    assert sorted(r["row_id"] for r in kept.collect()) == sorted(d[0] for d in data if d[1] in small and d[2] == 6.0)


class _Counting:
    """Notes every prompt it answers and refuses some, with the batch they are in."""

    def __init__(self, bad):
        self.bad, self.answered, self.calls = set(bad), [], 0

    def answer(self, prompts):
        self.calls += 1
        if self.bad & set(prompts):
            raise RuntimeError("refused")
        self.answered += list(prompts)
        return prompts.str.upper()


def test_failing_prompts_are_cut_out():
    """Each good prompt is answered once; calls follow the failures, not the prompts."""
    import pandas as pd
    from textlake.operators.model import answer_apart
    prompts = pd.Series([f"p{i}" for i in range(500)], index=range(7, 507))
    for bad in ([], ["p0"], ["p499"], ["p3", "p4", "p250"], list(prompts)):
        model = _Counting(bad)
        got = answer_apart(model, prompts)
        assert got["answer"].tolist() == [None if p in model.bad else p.upper() for p in prompts]
        assert got["error"].tolist() == ["RuntimeError: refused" if p in model.bad else None for p in prompts]
        assert sorted(model.answered) == sorted(set(prompts) - model.bad)
        assert model.calls <= 1 + 3 * 6 * max(1, len(bad)) if len(bad) < 9 else model.calls < 2 * len(prompts)
    assert len(answer_apart(_Counting([]), prompts.iloc[:0])) == 0
    class Short:
        def answer(self, some):
            return some.iloc[1:]
    assert answer_apart(Short(), prompts.iloc[:1])["error"].tolist() == ["ValueError: 0 answers to 1 prompts"]


def test_failures_are_asked_again_and_answers_are_not(spark):
    from textlake.operators.model import RuleModel, model_map
    from textlake.plans.eva import PickyModel
    from textlake.session import scratch_path
    docs = spark.createDataFrame([(1, "echo\t1"), (2, "echo\t97"), (3, "echo\t97"), (4, None)], "id int, q string")
    path = scratch_path(spark, "answers")
    def run(model):
        out = model_map(docs, "q", model, cache_path=path, tasks=1, keep_errors=True)
        return sorted((r["id"], r["answer"], r["answer_status"], r["answer_error"]) for r in out.collect())
    first = run(PickyModel())
    assert first == [(1, "1", "answered", None), (2, None, "failed", "ValueError: number refused"),
                     (3, None, "failed", "ValueError: number refused"), (4, None, "no prompt", None)]
    class Other(RuleModel):
        def answer(self, prompts):
            return prompts.map(lambda p: "again " + p[5:])
    assert [r[1:3] for r in run(Other())] == [("1", "answered"), ("again 97", "answered"), ("again 97", "answered"), (None, "no prompt")]


def test_branch_graph(spark):
    """NULL and hot groups, groups that a branch empties, branches of both kinds, no group at all, clashing names."""
    from textlake.operators import semantic as S
    trunk = spark.createDataFrame([(i, "t", None if i % 4 == 0 else "hot" if i % 7 else "b", float(i), 1) for i in range(60)],
                                  "row_id int, contents string, g string, v double, _key_0 int")
    other = spark.createDataFrame([(i, "o", i // 2, i * 10.0) for i in range(20)], "row_id int, contents string, ref int, w double")
    join = {"op": "join", "left": "trunk", "right": "other", "on": ("row_id", "ref")}
    steps = [{"op": "filter", "where": "v < 50"}, {"op": "group", "keys": ["g"]}]
    branches = {"n": [{"op": "agg", "func": "count"}], "n_low": [{"op": "filter", "where": "v < 3"}, {"op": "agg", "func": "count"}],
                "n_join": [join, {"op": "agg", "func": "count"}], "best": [join, {"op": "agg", "func": "max", "field": "w"}],
                "large": [{"op": "agg", "func": "count", "having": "value > 11"}],
                "kept": [{"op": "topk", "per": "group", "by": "v", "k": 2}, {"op": "agg", "func": "min", "field": "v"}],
                "label": [{"op": "agg", "func": "max", "field": "g", "type": "string"}]}
    out = S.run_graph({"data": trunk, "other": other}, steps, branches, {"twice": lambda n: n * 2})
    got = {r["g"]: r.asDict() for r in out.collect()}
    rows = [(i, None if i % 4 == 0 else "hot" if i % 7 else "b") for i in range(50)]
    assert set(got) == {None, "hot", "b"}
    for g, r in got.items():
        mine = [i for i, k in rows if k == g]
        joined = [j * 10.0 for j in range(20) if j // 2 in mine]
        assert r == {"g": g, "n": len(mine), "n_low": sum(i < 3 for i in mine), "n_join": len(joined), "best": max(joined, default=None),
                     "large": len(mine) if len(mine) > 11 else 0, "kept": sorted(mine)[-2], "label": g, "twice": 2.0 * len(mine)}
    alone = S.run_graph({"data": trunk, "other": other}, [], {"n": branches["n"], "n_join": branches["n_join"]}).collect()
    assert [tuple(r) for r in alone] == [(60.0, 20.0)]
    none = S.run_graph({"data": trunk.limit(0), "other": other}, steps, branches).collect()
    assert none == []


def test_branch_graph_reads_its_trunk_once(spark, tmp_path):
    """The source is read for the stored trunk alone; folded branches share one pass over that."""
    from textlake.operators import semantic as S
    spark.range(100).selectExpr("id", "id % 3 as g").write.parquet(str(tmp_path / "t"))
    source = spark.read.parquet(str(tmp_path / "t"))
    out = S.run_graph({"t": source}, [{"op": "group", "keys": ["g"]}],
                      {f"n{i}": [{"op": "filter", "where": f"id > {i}"}, {"op": "agg", "func": "count"}] for i in range(4)})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan.lower() and plan.count("LogicalRDD") == 1
    assert sorted(r["n0"] for r in out.collect()) == [33.0, 33.0, 33.0]


class _Stubborn:
    """Right in a certain round for some rows, wrong in another way each time or always the same for others."""

    def answer(self, prompts):
        return prompts.map(self.one)

    @staticmethod
    def one(prompt):
        kind, field, value, *rest = prompt.split("\t")
        if value == "lost":
            raise RuntimeError("no connection")
        if value == "same":
            return "Nothing to say."
        if kind == "restate" and rest[0] == "3" and value == "third":
            assert rest[1:] == ["no field", "Draft 2."], rest
            return f"The {field} is third."
        return "Draft 1." if kind == "state" else f"Draft {rest[0]}."


def test_remediation_goes_by_round_and_reason(spark):
    from textlake.operators import detect
    rows = [(1, "city", "Paris", "The city is Paris."), (2, "city", "third", "Unclear."), (3, "city", "same", "Unclear. (Hash: 0a1b)"),
            (4, "city", "lost", "Unclear."), (5, "city", None, None)]
    data = spark.createDataFrame([(i, f, v, "STANDARD", s) for i, f, v, s in rows], "id int, field string, value string, field_class string, sentence string")
    got = {r["id"]: (r["sentence"], r["fixed_in"]) for r in detect.remediate(data, _Stubborn(), rounds=4).collect()}
    assert len(got) == 5 and got[1] == ("The city is Paris.", 0) and got[2] == ("The city is third.", 3)
    assert got[3][1] == got[4][1] == 5 and got[4][0] == "The city value is lost."
    early = detect.remediate(data.where("id in (3, 4)"), _Stubborn(), rounds=50)
    assert {r["fixed_in"] for r in early.collect()} == {51}
    assert early._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 4  # two rounds, not fifty


def test_labels_of_finals_tell_groups_apart(spark):
    from textlake.operators import semantic as S
    docs = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), ("NULL", "x"), ("", "x")], "k string, l string")
    out = S.run_steps({"t": docs}, [{"op": "group", "keys": ["k", "l"]}, {"op": "agg", "func": "count", "field": "*"}])[0]
    assert len({r["group_key"] for r in out.collect()}) == 5
