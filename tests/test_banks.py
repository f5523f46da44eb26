"""Banks whose sentences hold several fields: stored, read, rendered and extracted again."""

import pytest

from textlake.functions.udtf import register_extract_fields
from textlake.operators import semantic as S
from textlake.operators.bank import Template, bank_from_df, bank_to_df, cut_wording
from textlake.operators.render import render_documents
from textlake.sources.readers import read_bank, read_tags
from textlake.sources.sinks import write_bank

BANK = [
    Template("name", ("The buyer is [NAME] of [CITY].", "In [CITY] lives [NAME]."), others=("city",), synonyms={"buyer": ("client", "customer")}),
    Template(None, ("A pause helps.",)),
    Template("debt", ("Debt of [SUM] is open.",), ("No debt, [SUM] is held.",), variation_class="BINARY", others=("sum",)),
    Template("age", ()),
    Template("code", ("[CODE] or [MARK] is the code.",), others=("mark",)),
]
ROWS = [(1, "Dr. Smith", "St. Paul", 1, 1.5, "a", "b"), (2, "X. In Rome", "A! B", 0, 2.0, "C", None), (3, None, "Ur", 1, None, "x", "y")]


def _stored(spark, tmp_path, bank):
    rows = bank_to_df(spark, bank).selectExpr("'d' as database", "'t' as table", "*")
    tags = spark.createDataFrame([("d", "t", "0a", "name", "the smith"), ("d", "t", "1b", "city", None)], "database string, table string, tag string, field string, replacement string")
    write_bank(rows, str(tmp_path / "bank"), tags)
    return str(tmp_path / "bank")


def test_cut_wording():
    assert cut_wording("Of [AB] and [A], [AB].", ("a", "ab")) == ("Of ", (("ab", " and "), ("a", ", "), ("ab", ".")))
    assert cut_wording("Nothing [B].", ("a",)) == ("Nothing [B].", ()) and cut_wording("x", ()) == ("x", ())


def test_bank_round_trips(spark, tmp_path):
    assert bank_from_df(bank_to_df(spark, BANK)) == BANK
    path = _stored(spark, tmp_path, BANK)
    assert bank_from_df(read_bank(spark, path, multi_line=False)) == BANK
    assert sorted(tuple(r) for r in read_tags(spark, path, False).collect()) == [("d", "t", "0a", "name", "the smith"), ("d", "t", "1b", "city", None)]
    with pytest.raises(ValueError):
        bank_from_df(bank_to_df(spark, BANK), max_rows=3)


def test_bank_as_others_store_it(spark, tmp_path):
    (tmp_path / "one.json").write_text("""{"database": "d", "table": "t", "templates": [
        {"primary_data_fields": ["A", "B"], "foreign_data_fields": ["C", "B"], "variations": ["[A] x [B] y [C].", "[A] x [B] y [C]."], "counter_variations": []},
        {"primary_data_fields": [], "is_static": true, "variations": ["Noise."]}, {"primary_data_fields": ["D"]}]}""")
    assert bank_from_df(read_bank(spark, str(tmp_path))) == [
        Template("A", ("[A] x [B] y [C].",), others=("B", "C")), Template(None, ("Noise.",)), Template("D", ())]


def test_rendered_and_extracted(spark, tmp_path):
    bank = [t for t in bank_from_df(read_bank(spark, _stored(spark, tmp_path, BANK), multi_line=False)) if t.field != "age"]
    rows = spark.createDataFrame(ROWS, "id int, name string, city string, debt int, sum double, code string, mark string")
    docs = render_documents(rows, bank, "id", "t").select("row_id", "contents")
    got = S.sem_extract(docs, bank, {"name": "string", "city": "string", "debt": "int", "sum": "double"}, []).drop("contents")
    assert sorted(map(tuple, got.collect())) == [r[:5] for r in ROWS]


def test_values_that_open_a_sentence(spark):
    docs = spark.createDataFrame([("A pause helps. Abc or def is the code. Free.",), ("X or NULL is the code.",), (None,)], "contents string")
    for plain in (False, True):
        got = S.sem_extract(docs, BANK, {"code": "string", "mark": "string"}, plain_values=plain).drop("contents")
        assert {tuple(r) for r in got.collect()} == {("Abc", "def"), ("X", None), (None, None)}


def test_a_field_said_twice(spark):
    bank = [Template("n", ("Number [N] it is, [N] of [M].", "Number [N] of [M]."), others=("m",)), Template("m", ("The m is [M].",))]
    docs = spark.createDataFrame([(1, "Number 5, 5 it is, 5, 5 of 7. The m is 8."), (2, "Number 4 of 9."), (3, "Number 4 it is, 5 of 9.")], "row_id int, contents string")
    got = S.sem_extract(docs, bank, {"n": "string", "m": "string"}, []).drop("contents")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "5, 5", "8"), (2, "4", "9"), (3, "4 it is, 5", "9")]
    with pytest.raises(KeyError):
        S.sem_extract(docs, bank, {"other": "string"}, [])


def test_values_that_can_be_parted_in_two_ways_are_conflicts(spark):
    docs = spark.createDataFrame([(1, "The buyer is A of B of C."), (2, "The buyer is A of B.")], "row_id int, contents string")
    assert sorted(tuple(r) for r in S.extraction_conflicts(docs, BANK[:1]).collect()) == [(1, "city"), (1, "name")]


def test_table_function_reads_several(spark):
    register_extract_fields(spark, BANK[:1], "read_two")
    got = spark.sql("select f.field, f.value from values ('In Rome lives Ann. In Ur lives Bo.') t(c), lateral read_two(c) f").collect()
    assert sorted(map(tuple, got)) == [("city", "Rome"), ("name", "Ann")]
