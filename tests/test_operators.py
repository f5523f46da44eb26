"""Operators on small fixtures, with hot keys, copies and awkward characters."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import rows
from textlake.operators import detect, generate, ordering, profile, render, semantic, validate
from textlake.operators.bank import Template, bank_from_df, bank_to_df, infer_class
from textlake.operators.model import RuleModel, model_map
from textlake.sources import readers, sinks


def skewed(spark, n=900):
    """One key holds a third of all rows; some keys and values are missing."""
    rng = random.Random(7)
    data = [(i, None if i % 50 == 1 else "hot" if i % 3 == 0 else f"k{rng.randrange(40)}",
             None if i % 31 == 2 else rng.randrange(50)) for i in range(n)]
    return spark.createDataFrame(data, "id bigint, k string, v int")


def test_number_rows_equals_window(spark):
    df = skewed(spark)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("id")))
    assert rows(ordering.number_rows(df, "id", ["k"], 7), "id", "rn") == rows(want, "id", "rn")


def test_rank_values_equals_window(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("v")
    want = df.select("id", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense_rank"),
                     F.percent_rank().over(w).alias("percent_rank"), F.cume_dist().over(w).alias("cume_dist"))
    got = ordering.rank_values(df, ["k"], "v", 5).select(*want.columns)
    assert rows(got) == rows(want)


def test_neighbours_equals_window(spark):
    df = skewed(spark).where("id % 4 <> 1")
    w = Window.partitionBy("k").orderBy("id")
    want = df.select("id", F.lag("v").over(w).alias("prev_v"), F.lead("v").over(w).alias("next_v"))
    assert rows(ordering.neighbours(df, ["k"], "id", "v", 11).select(*want.columns)) == rows(want)


def test_bank_classes_and_round_trip(spark):
    assert infer_class(("a",), ("is NULL",), ()) == "NULL"
    assert infer_class(("a",), ("b",), ()) == "BINARY"
    assert infer_class(("a",), ("b",), ("c",)) == "NULLABLE_BINARY"
    assert infer_class(("a",), (), ()) == "STANDARD"
    bank = [Template("x", ("It is [X].", "[X] it is."), ("No x.",)), Template(None, ("Noise.",))]
    assert bank_from_df(bank_to_df(spark, bank)) == bank


AWKWARD = ["R|S", "$1", "a\\b", "(x)", "[Y]", "3.50", "007x", "tab\tbed", "it's", "50%", "é ü"]


def test_values_survive_render_and_extract(spark):
    bank = [Template("v", ("The thing is named [V].", "People say [V] to it.")), Template("n", ("Its number is [N].",))]
    df = spark.createDataFrame([(i, v, i * 1.5) for i, v in enumerate(AWKWARD)], "id bigint, v string, n double")
    docs = render.render_documents(df, bank, "id", "t", noise=["Some noise here."], ratio=(1, 1))
    back = semantic.sem_extract(docs, bank, {"v": "string", "n": "double"}).select("row_id", "v", "n")
    # pipes are delimiters and are dropped, inner white space is squeezed, as in the rendered text
    want = sorted((i, " ".join(v.replace("|", "").split()), i * 1.5) for i, v in enumerate(AWKWARD))
    assert sorted((r.row_id, r.v, r.n) for r in back.collect()) == want


@pytest.mark.parametrize("x,y", [(1, 0), (1, 1), (1, 2), (2, 1), (3, 2)])
def test_noise_is_exact_and_keeps_order(spark, x, y):
    noise = [f"Noise {i}." for i in range(4)]
    df = spark.createDataFrame([(n, [f"Data {i}." for i in range(n)]) for n in range(0, 9)], "n int, s array<string>")
    out = df.select("n", render.weave_noise(F.col("s"), noise, x, y, "s", F.col("n").cast("string")).alias("w"))
    for r in out.collect():
        data = [s for s in r.w if s.startswith("Data")]
        expected = 0 if y == 0 or r.n == 0 else max(y, -(-r.n * y // x))
        assert data == [f"Data {i}." for i in range(r.n)]
        assert len(r.w) - len(data) == expected


def test_no_repeat_uses_a_pool_before_repeating(spark):
    bank = [Template("v", tuple(f"Wording {i} of [V]." for i in range(5)))]
    df = spark.range(100).select(F.col("id"), F.lit("z").alias("v"))
    s = render.render_sentences(df, bank, "id", no_repeat=True).select(F.col("sentences")[0].alias("s"), "row_id")
    for block in range(0, 100, 5):
        assert s.where(F.col("row_id").between(block, block + 4)).distinct().select("s").distinct().count() == 5


def test_each_distinct_prompt_is_asked_once(spark, tmp_path):
    class Counting(RuleModel):
        def answer(self, prompts):
            (tmp_path / f"n{len(prompts)}-{abs(hash(tuple(prompts)))}").write_text("\n".join(prompts))
            return super().answer(prompts)
    df = spark.range(300).select("id", F.concat(F.lit("echo\tp"), F.col("id") % 7).alias("p"))
    cache = spark.createDataFrame([("echo\tp3", "stored")], "prompt string, answer string")
    out = model_map(df, "p", Counting(), "a", cache, str(tmp_path / "cache"))
    assert out.count() == 300
    assert {r.a for r in out.select("a").distinct().collect()} == {"stored", *(f"p{i}" for i in range(7) if i != 3)}
    asked = [line for f in tmp_path.glob("n*") for line in f.read_text().splitlines()]
    assert len(asked) == len(set(asked)) == 6


def _jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("threshold", [0.2, 0.55, 0.8])
def test_similar_texts_equals_brute_force_with_copies(spark, threshold):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(30)]
    texts = [" ".join(rng.sample(words, rng.randrange(2, 9))) for _ in range(60)]
    texts += [texts[0]] * 30                         # a third of the rows are copies
    a = [(i, t) for i, t in enumerate(texts)]
    b = [(i, " ".join(rng.sample(words, 6))) for i in range(20)]
    sets = {("a", i): set(t.split()) for i, t in a} | {("b", i): set(t.split()) for i, t in b}
    want = sorted((i, j) for i, _ in a for j, _ in b if _jaccard(sets["a", i], sets["b", j]) >= threshold)
    out = validate.similar_texts(spark.createDataFrame(a, "ia int, text string"),
                                 spark.createDataFrame(b, "ib int, text string"), "ia", "ib", threshold=threshold)
    assert sorted((r.ia, r.ib) for r in out.collect()) == want


def test_templatize_skips_the_name(spark):
    df = spark.createDataFrame([
        ("The CALPADS 1 value is 1.", "CALPADS 1", "1"), ("A price of 5.0 or 5 holds.", "price", "5.0"),
        ("Nothing here.", "x", "y"), ("a+b is a+b", "sum", "a+b"), ("Free text", None, None)], "s string, f string, v string")
    out = [r[0] for r in df.select(detect.templatize(F.col("s"), F.col("f"), F.col("v"))).collect()]
    assert out == ["The CALPADS 1 value is [CALPADS 1].", "A price of [PRICE] or 5 holds.", "Nothing here.",
                   "[SUM] is [SUM]", "Free text"]


def test_numbered_names_hide_their_digits(spark):
    df = spark.createDataFrame([("The line 2 item ships.", "count", "2"), ("There are 2 of them.", "count", "2")],
                               "s string, f string, v string")
    out = [r[0] for r in df.select(detect.name_in_sentence(F.col("s"), F.lit("amount"), F.col("v"), ["line 2"])).collect()]
    assert out == ["", "field_value"]


def test_fragments_merge(spark):
    df = spark.createDataFrame([(["In fact,", "The price is 5. (Hash: 0a)", "So", "TBD", "End"],), ([],)], "s array<string>")
    out = [r[0] for r in df.select(render.merge_fragments(F.col("s"))).collect()]
    assert out == [["In fact, the price is 5. (Hash: 0a)", "So", "TBD", "End"], []]


def test_conflicts_and_roles(spark):
    d = spark.createDataFrame([
        (1, 0, "a", "7", "field_value", "foreign"), (1, 0, "grade 7", "x", "field_name_direct", "foreign"),
        (1, 0, "b", "q", "field_name_direct", "primary")],
        "k bigint, pos int, field string, value string, match_type string, role string")
    assert rows(detect.resolve_conflicts(d, "k"), "field") == [("b",), ("grade 7",)]
    roles = detect.assign_roles(d.drop("role"), "k")
    assert rows(roles.where("role = 'primary'"), "field") == [("grade 7",)]


def test_variations_are_asked_again_when_none_fits(spark):
    class Late(RuleModel):
        def _one(self, prompt):
            return "1. It is not specified at all." if "attempt 2" in prompt else "1. Useless wording here."
    s = spark.createDataFrame([("Some sentence.",)], "sentence string")
    out = generate.expand_variations(s, 2, Late(), null_phrases=["not specified"])
    assert rows(out, "wording") == [("It is not specified at all.",)]


def test_profile_order_of_classes(spark):
    df = spark.createDataFrame([
        ("1", None, "-", "1", "a", "2024-01-01", "1,000"), ("0", "1", "+", "", "b", "2024-02-02", "$2.5")],
        "bin string, nb string, misc string, gap string, std string, day string, amount string")
    got = {r.field: (r.field_class, r.data_type) for r in profile.profile_columns(df).collect()}
    assert got == {"bin": ("BINARY", "bool"), "nb": ("NULLABLE_BINARY", "bool"), "misc": ("MISC", "string"),
                   "gap": ("NULLABLE_BINARY", "bool"), "std": ("STANDARD", "string"), "day": ("STANDARD", "date"),
                   "amount": ("STANDARD", "float")}


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text("".join(f"line {i}\n" for i in range(1, 5001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = readers.read_lines(spark, str(path))
        assert lines.select("file_path", "line_no").distinct().count() == 5000
        assert lines.where(F.concat(F.lit("line "), F.col("line_no")) != F.col("value")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_existing_keys_are_skipped(spark, tmp_path):
    new = spark.range(10).withColumnRenamed("id", "k")
    sinks.append_missing(new, spark.range(4).withColumnRenamed("id", "k"), ["k"], str(tmp_path / "out"))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "k") == [(i,) for i in range(4, 10)]


def test_dedup_and_setops_with_hot_key(spark):
    df = skewed(spark)
    first = semantic.sem_dedup(df.withColumnRenamed("id", "row_id"), ["k"])
    want = df.groupBy("k").agg(F.min("id").alias("row_id"))
    assert rows(first, "k", "row_id") == rows(want, "k", "row_id")


def test_narrow_render_has_no_shuffle(spark):
    bank = [Template("v", ("It is [V].", "[V] it is."), synonyms={"is": ("remains",)})]
    df = spark.range(10).select("id", F.lit("z").alias("v"))
    plan = render.render_documents(df, bank, "id", "t", noise=["N."], ratio=(1, 1))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_roles_and_conflicts_of_three(spark):
    """Three-way cases: names used up by earlier sentences, removed detections that meet nobody, ties."""
    d = spark.createDataFrame([
        ("t", 0, "a", "field_value", "1"), ("t", 0, "b", "field_value", "2"), ("t", 1, "b", "field_name_direct", "2"), ("t", 1, "a", "field_value", "1"),
        ("t", 1, "c", "field_value", "3"), ("t", 2, "b", "hash_validated", "2"), ("u", 0, "b", "", "2")], "k string, pos int, field string, match_type string, value string")
    roles = detect.assign_roles(d, "k")
    assert rows(roles.where("role = 'primary'"), "k", "pos", "field") == [("t", 0, "b"), ("t", 1, "c"), ("t", 2, "b"), ("u", 0, "b")]
    c = spark.createDataFrame([
        (1, 0, "a", "x", "field_value", "foreign"), (1, 0, "bb", "xy", "field_value", "foreign"), (1, 0, "ccc", "xyz", "field_value", "foreign"),
        (2, 0, "a", "x", "field_value", "primary"), (2, 0, "bb", "xy", "field_name_direct", "foreign"), (2, 0, "c x", "q", "hash_validated", "foreign"),
        (3, 0, "a", "x", "hash_validated", "foreign"), (3, 0, "b", "x", "hash_validated", "foreign"), (4, 0, "a", None, "field_value", "foreign"), (4, 0, "b", "v", "", "foreign")],
        "k int, pos int, field string, value string, match_type string, role string")
    left = rows(detect.resolve_conflicts(c, "k"), "k", "field")
    assert left == [(1, "ccc"), (2, "a"), (3, "a"), (3, "b"), (4, "a"), (4, "b")]
    assert "Python" not in roles._jdf.queryExecution().toString() and "InPandas" not in roles._jdf.queryExecution().toString()
