"""Documents cut as a whole: values with sentence ends, line breaks and wordings of other slots."""

from textlake.operators import semantic as S
from textlake.operators.bank import Template

BANK = [Template("name", ("The customer on file is [NAME].",)),
        Template("city", ("It sits in [CITY].", "Its city is [CITY] now.")),
        Template("seg", ("The market segment is [SEG].", "Trade falls under [SEG]."), synonyms={"market": ("trade", "sales")}),
        Template("debt", ("It is in debt.",), ("It has no debt.",), variation_class="BINARY")]
FIELDS = {"name": "string", "city": "string", "seg": "string", "debt": "int"}
CASES = [
    ("The customer on file is Dr. Smith. It sits in St. Paul.", ("Dr. Smith", "St. Paul", None, None)),
    ("The customer on file is Acme Inc. (East). Moreover, its city is Rome. Or\nParis now. The sales segment is A.B.\n\nIt has no debt.",
     ("Acme Inc. (East)", "Rome. Or\nParis", "A.B", 0)),
    ("The customer on file is Real. It sits in X. The customer on file is Y. Trade falls under Z. It is in debt.", ("Real", "X. The customer on file is Y", "Z", 1)),
    ("The customer on file is Acme. The market segment is B. It sits in R. The market segment is C.", ("Acme. The market segment is B", "R", "C", None)),
    ("A short pause helps. The customer on file is A! B? C. A short pause helps. It sits in NULL.", ("A! B? C", None, None, None)),
    ("Unknown text.", (None,) * 4), ("", (None,) * 4), (None, (None,) * 4),
    ("The customer on file is " + "very. " * 3000 + "long.", (("very. " * 3000 + "long"), None, None, None)),
]


def test_values_are_read_whole(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(CASES)], "row_id int, contents string, _segments string")
    found = S.sem_extract(docs, BANK, FIELDS, ["A short pause helps."])
    assert found.columns == [*docs.columns, *FIELDS]
    got = {r["row_id"]: tuple(r[f] for f in FIELDS) for r in found.collect()}
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]
    assert found.where("name like 'Dr.%'").count() == 1


def test_equally_good_readings_are_conflicts(spark):
    docs = spark.createDataFrame([(1, "The customer on file is A. Trade falls under B. Trade falls under C."), (2, CASES[2][0]), (3, None)], "row_id int, contents string")
    assert [(r["row_id"], r["field"]) for r in S.extraction_conflicts(docs, BANK).collect()] == [(1, None)]


def test_unknown_sentences_between(spark):
    docs = spark.createDataFrame([("The customer on file is Dr. Smith. It sits in St. Paul.",), ("The customer on file is Acme Inc. (East). Who knows this. It sits in X.",)], "contents string")
    assert sorted(tuple(r) for r in S.sem_extract(docs, BANK, {"name": "string", "city": "string"}).drop("contents").collect()) == [("Acme Inc. (East)", "X"), ("Dr. Smith", "St. Paul")]
