"""Steps that must grow with their input: what is collected, how work is dealt, what pairs cost."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from textlake.functions import text as X
from textlake.operators import detect, generate, validate
from textlake.operators.model import RuleModel
from textlake.plans import QUERIES


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


def many(spark, tmp_path, sql, n=2000):
    """A stored table whose rows are exploded in the plan, so that Spark takes them for small."""
    path = str(tmp_path / "rows")
    spark.range(n).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).selectExpr("id as row_id", f"inline({sql})")


def test_tags_are_not_collected(spark, tmp_path, capsys):
    t = many(spark, tmp_path, "array(struct('0a' as tag, 'The size is 5.' as sentence, 'size' as field, '5' as value, 'STANDARD' as field_class, cast(null as string) as replacement))")
    out = detect.resolve_by_tag(t.select("row_id", "tag", "sentence"), t.drop("sentence"))
    assert "BroadcastHashJoin" not in plan_of(out, capsys)
    assert rows(out.where("row_id < 2")) == [(i, "0a", "size", "5", "field_name_direct") for i in range(2)]


def test_orphans_are_not_collected(spark, tmp_path, capsys):
    t = many(spark, tmp_path, "array(struct('size' as field, '1b' as tag, false as is_tbd, 0 as tmpl_ix, 'brand' as slot, false as is_static, 'The measured size comes to five units.' as original))")
    out = validate.orphan_columns(t.select("row_id", "field", "tag", "is_tbd"), t.select("row_id", "tmpl_ix", F.col("slot").alias("field"), "is_static", "original"),
                                  t.select("row_id", "tag", F.lit("The measured size comes to five inches.").alias("sentence")), ["row_id"])
    assert "BroadcastHashJoin" not in plan_of(out, capsys)
    assert rows(out.where("row_id < 2"), "field", "tmpl_ix", "matched_by") == [("size", 0, "similar")] * 2


def test_patterns_are_made_and_worded_once(spark, capsys):
    s = spark.createDataFrame([(i, 0, f"The maker is m{i} of course. (Hash: 0a)", "0a", "maker") for i in range(40)] + [(i, 1, "Free words.", None, None) for i in range(40)],
                              "row_id int, pos int, sentence string, tag string, field string")
    values = spark.createDataFrame([(i, "maker", f"m{i}", "STANDARD") for i in range(40)], "row_id int, field string, value string, field_class string")
    out = generate.templates_from_sentences(s, values, RuleModel(), 2)
    plan = plan_of(out, capsys)
    assert "ExistingRDD" in plan and "BroadcastHashJoin [row_id" not in plan and "\\Q" not in plan
    got = rows(out, "row_id", "pos", "vid", "pattern")
    assert len(got) == 160 and got[:2] == [(0, 0, 0, "The maker is [MAKER] of course."), (0, 0, 1, "In this case, the maker is [MAKER] of course.")]


def test_merged_documents_are_not_cut_into_sentences(spark, capsys):
    from textlake.plans import QUERIES
    assert "lambda" not in plan_of(QUERIES["sem_5_merge_joined"](spark, "/root/testdata/sf0.001"), capsys)


def test_heavy_scans_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    from textlake import session
    monkeypatch.setattr(session, "TASK_ROWS", 1000)
    spark.range(40_000).coalesce(1).write.parquet(str(tmp_path / "one"))
    dealt = session.spread(spark.read.parquet(str(tmp_path / "one")), "id")
    assert dealt.rdd.getNumPartitions() == 40 and dealt.distinct().count() == 40_000


def test_phrases_are_searched_in_one_lower_text(spark, capsys):
    phrases = ["is a", "serves as a", "this is a", "t", "true", "Is A", "yes"]
    texts = ["This IS A x", "serves as", "no", "YES", "", None, "Truth"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    out = df.select("s", X.holds_phrase(F.col("s"), phrases).alias("held"))
    assert {r["s"]: r["held"] for r in out.collect()} == {t: t if t is None else any(p in t.lower() for p in phrases) for t in texts}
    assert "this is a" not in plan_of(out, capsys)


def test_closed_sentences_are_left_alone(spark):
    texts = ["A b.", "A b", "A b..", "A b!", "A b?", ".", "", None, "A b.\n", "A b\n", "é..", "A  b", "N/A is 5%."]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    old = F.regexp_replace(F.regexp_replace(F.trim("s"), r"([^.!?])$", "$1."), r"\.\.$", ".")
    plain = df.where("s is null or s rlike '^[A-Za-z]* ?[a-z]?[.!?]*\\\\z'")
    assert rows(plain.select(X.clean_sentence(F.col("s")).alias("t"))) == rows(plain.select(old.alias("t")))


@pytest.mark.parametrize("threshold", [0.5, 0.55, 0.8])
def test_links_are_counted_as_brute_force_lists_them(spark, threshold, monkeypatch):
    monkeypatch.setattr(validate, "MAX_PARTS", 40)  # short and long sets
    rng = random.Random(3)
    words = [f"word{i}" for i in range(14)]
    texts = [" ".join(rng.sample(words, rng.choice([1, 3, 5, 6, 8, 9, 12]))) for _ in range(90)]
    a = [(i, t) for i, t in enumerate(texts[:45] + texts[:9] + [None, "", "a b"])]
    b = [(100 + i, t) for i, t in enumerate(texts[45:] + texts[:20] + [None, ""])]
    got = rows(validate.text_links(spark.createDataFrame(a, "k int, text string"), spark.createDataFrame(b, "k int, text string"), "k", threshold=threshold))
    want = []
    for side, mine, other in (("a", a, b), ("b", b, a)):
        sets = [(k, frozenset(w for w in (t or "").split() if len(w) > 2)) for k, t in mine]
        others = [frozenset(w for w in (t or "").split() if len(w) > 2) for _, t in other]
        for k, s in sets:
            n = sum(bool(s) and len(s & o) / len(s | o) >= threshold for o in others)
            want.append((side, k, min(j for j, x in sets if x == s) if s else k, n))
    assert got == sorted(want, key=repr)


def test_two_large_sides_list_every_pair(spark, tmp_path):
    notes = [(2, 700, "2000-01-01", 51000.0), (3, 701, "2000-09-09", 51999.0), (5, 700, "2001-01-01", 51000.0), (7, 700, "2000-01-01", 51500.0), (9, 702, "1999-01-01", 52000.0),
             (4, 700, "2000-03-01", 51020.0), (4, 700, "2000-03-01", 51020.0), (11, None, "2000-01-01", 51000.0), (6, 1, "2000-01-01", 2000.0), (13, 2, "2000-01-01", 3000.0)]
    (spark.createDataFrame(notes, "o_orderkey long, o_custkey long, day string, o_totalprice double")
     .selectExpr("*", "timestamp(day) as o_orderdate", "'F' as o_orderstatus").write.parquet(str(tmp_path / "orders.parquet")))

    def words(note):
        _, customer, day, price = note
        return {"placed", "customer", "worth", "about", "under", "status"} | {w for w in (f"c{customer}", day[:4], f"t{int(price // 1000)}") if len(w) > 2}
    known = [n for n in notes if n[1] is not None]
    want = [(a[0], b[0], len(words(a) & words(b)) / len(words(a) | words(b))) for a in known for b in known if a[0] % 2 == 0 and b[0] % 2 == 1]
    out = QUERIES["val_8_two_large_sides"](spark, str(tmp_path))
    assert rows(out, "even_key", "odd_key", "similarity") == sorted((w for w in want if w[2] >= 0.8), key=repr)


@pytest.mark.parametrize("threshold,pairs,within", [(0.2, 1 << 26, []), (0.55, 5, ["g"]), (0.8, 1 << 26, []), (0.8, 5, [])])
def test_dense_sides_are_listed_as_brute_force_lists_them(spark, threshold, pairs, within, monkeypatch):
    monkeypatch.setattr(validate, "MAX_PARTS", 40)  # short and long sets
    monkeypatch.setattr(validate, "TASK_PAIRS", pairs)  # parts in one task, or dealt to several
    rng = random.Random(4)
    words = ["common", *(f"word{i}" for i in range(13))]
    texts = [" ".join({"common", *rng.sample(words, rng.choice([1, 3, 5, 6, 8, 9, 12]))}) for _ in range(90)]
    a = [(i % 2, i, t) for i, t in enumerate(texts[:45] + texts[:9] + [None, "", "a b", "word1 word2"])] + [(0, 0, texts[0])]
    b = [(i % 2, 100 + i, t) for i, t in enumerate(texts[45:] + texts[:20] + [None, ""])]
    sets = {t: frozenset(w for w in (t or "").split() if len(w) > 2) for _, _, t in a + b}
    want = [(i, j, len(sets[t] & sets[u]) / len(sets[t] | sets[u])) for g, i, t in a for h, j, u in b if sets[t] and sets[u] and (g == h or not within)]
    out = validate.similar_texts(spark.createDataFrame(a, "g int, ka int, text string"), spark.createDataFrame(b, "g int, kb int, text string"), "ka", "kb",
                                 threshold=threshold, within=within, dense=True)
    assert rows(out, "ka", "kb", "similarity") == sorted((w for w in want if w[2] >= threshold), key=repr)


def test_dense_pairs_do_not_travel(spark, capsys):
    notes = [(i, f"alpha beta gamma delta epsilon word{i % 3}") for i in range(60)]
    out = validate.similar_texts(spark.createDataFrame(notes, "ka int, text string"), spark.createDataFrame(notes, "kb int, text string"), "ka", "kb", threshold=0.8, dense=True)
    plan = plan_of(out, capsys).split("\n\n")[0]
    assert plan.count("Exchange") == 2 and plan.count("Join") == 1 and plan.index("Join") < plan.index("Exchange")  # below the join only
    assert out.count() == 3 * 20 * 20


def test_word_sets_are_made_once(spark, capsys):
    a = [(i, f"alpha beta gamma delta word{i} other{i}") for i in range(30)] + [(30, "alpha beta gamma delta"), (31, "alpha beta gamma word1"), (32, None), (33, "to"), (34, "Beta, gamma alpha delta; delta")]
    b = [(0, "alpha beta gamma delta"), (1, "alpha beta epsilon zeta"), (2, None), (3, "")]
    out = validate.similar_texts(spark.createDataFrame(a, "ka int, text string"), spark.createDataFrame(b, "kb int, text string"), "ka", "kb", threshold=0.66)
    assert "split(" not in plan_of(out, capsys)  # the join reads what was stored
    want = [(i, 0, 4 / 6) for i in range(30)] + [(30, 0, 1.0), (34, 0, 1.0)]
    assert rows(out, "ka", "kb", "similarity") == sorted(want, key=repr)
