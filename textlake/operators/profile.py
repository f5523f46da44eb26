"""Profiling of source columns.

Column statistics are computed on the wide table in a single aggregate: rows are never
multiplied by the number of columns, and only one partial row per task is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake import vocab
from textlake.functions import text as T
from textlake.sources.readers import value_text

# --- fixed values: domains and their keywords --------------------------------------
DOMAIN_KEYWORDS = {
    "educational": ["school", "student", "education", "grade", "enrollment", "academic", "teacher", "classroom"],
    "financial": ["account", "transaction", "balance", "payment", "loan", "credit", "bank", "financial"],
    "healthcare": ["patient", "medical", "diagnosis", "treatment", "hospital", "clinic", "health", "doctor"],
    "business": ["company", "employee", "revenue", "sales", "customer", "client", "business", "corporate"],
    "research": ["study", "analysis", "data", "research", "experiment", "hypothesis", "findings", "results"],
    "government": ["department", "agency", "public", "government", "citizen", "policy", "administrative"],
    "technology": ["system", "software", "application", "database", "technology", "digital", "platform"],
    "manufacturing": ["product", "production", "manufacturing", "factory", "inventory", "supply", "quality"],
}


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
                                    for name, df in tables.items()])


def unpivot_rows(df: DataFrame, key: str, sample: int | None = None) -> DataFrame:
    """Long form ``(row_id, ordinal, field, value)``; ``sample`` keeps the first rows by key."""
    if sample is not None:
        df = df.orderBy(key).limit(sample)
    fields = [f for f in df.schema.fields if f.name != key]
    cells = F.array(*[F.struct(F.lit(i + 1).alias("ordinal"), F.lit(f.name).alias("field"),
                               value_text(F.col(f.name), f.dataType).alias("value"))
                      for i, f in enumerate(fields)])
    return df.select(F.col(key).alias("row_id"), F.inline(cells))


# tests a column passes when all its filled values pass, one bit each
_TESTS = ["01", "misc", "bool", "int", "float", "date", "email", "url"]
_MISSING, _ALL = 1 << len(_TESTS), (1 << len(_TESTS)) - 1


def _value_bits(v: Column) -> Column:
    """The tests a filled value passes as bits; a missing value has only the bit for missing."""
    def bits(text: Column) -> Column:
        bare = F.trim(text)
        digits, amount = F.translate(text, ", ", ""), F.translate(text, ", $%", "")
        passed = [
            bare.isin("0", "1"), T.is_misc(text), F.lower(bare).isin(vocab.BOOL_WORDS_PROFILE),
            digits.rlike(r"^\s*[+-]?\d+\s*$"),
            amount.rlike(vocab.NUMBER) | amount.rlike(r"(?i)^\s*[+-]?(?:inf|infinity|nan)\s*$"),
            bare.rlike(vocab.DATE_WHOLE), bare.rlike(vocab.EMAIL), bare.rlike(vocab.URL_START)]
        return reduce(lambda a, b: a.bitwiseOR(b),
                      [F.when(p, 1 << i).otherwise(0) for i, p in enumerate(passed)])
    return F.when(T.is_null_word(v, vocab.NULL_WORDS_PROFILE), _MISSING).otherwise(T.let(v, bits))


def _folded(b: Column) -> dict[str, Column]:
    """Aggregates of the bits of a column: rows, bits seen at all, bits every filled value has."""
    filled = F.when(b != _MISSING, b)
    return {"n_rows": F.count(F.lit(1)), "any_bits": F.bit_or(b), "n_filled": F.count(filled),
            "all_bits": F.coalesce(F.bit_and(filled), F.lit(_ALL))}


def _passes(test: str) -> Column:
    return F.col("all_bits").bitwiseAND(1 << _TESTS.index(test)) != 0


def _class_of() -> Column:
    gaps, some = F.col("any_bits").bitwiseAND(_MISSING) != 0, F.col("n_filled") > 0
    return (F.when(gaps & some & _passes("01"), "NULLABLE_BINARY").when(gaps, "NULL").when(_passes("misc"), "MISC")
            .when(_passes("01"), "BINARY").otherwise("STANDARD"))


def _type_of() -> Column:
    chain = F.when(F.col("n_filled") == 0, "null")
    for name in _TESTS[2:]:
        chain = chain.when(_passes(name), name)
    return chain.otherwise("string")


def profile_columns(df: DataFrame, key: str | None = None) -> DataFrame:
    """Class and value type of every column: ``(field, ordinal, field_class, data_type, n_rows)``."""
    fields = [f for f in df.schema.fields if f.name != key]
    bits = df.select(*[_value_bits(value_text(F.col(f.name), f.dataType)).alias(f"b{i}") for i, f in enumerate(fields)])
    aggs, packs = [], []
    for i, f in enumerate(fields):
        folded = _folded(F.col(f"b{i}"))
        aggs += [c.alias(f"s{i}_{n}") for n, c in folded.items()]
        packs.append(F.struct(F.lit(f.name).alias("field"), F.lit(i + 1).alias("ordinal"),
                              *[F.col(f"s{i}_{n}").alias(n) for n in folded]))
    return (bits.agg(*aggs).select(F.inline(F.array(*packs)))
            .select("field", "ordinal", _class_of().alias("field_class"), _type_of().alias("data_type"), "n_rows"))


def profile_long(long: DataFrame, keys: list[str]) -> DataFrame:
    """As ``profile_columns`` for values already in long form; partial aggregates before the shuffle."""
    bits = long.withColumn("_bits", _value_bits(F.col("value")))
    return (bits.groupBy(*keys).agg(*[c.alias(n) for n, c in _folded(F.col("_bits")).items()])
            .select(*keys, _class_of().alias("field_class"), _type_of().alias("data_type"), "n_rows"))


def row_field_class(field: Column, value: Column) -> Column:
    """Class judged from a single value and the field's name."""
    id_like = F.lower(field).rlike("|".join(vocab.ID_LIKE_KEYWORDS))
    return (F.when(T.is_null_word(value, vocab.NULL_WORDS_PROFILE), "NULL")
            .when(T.is_misc(F.trim(value)), "MISC")
            .when(field.contains("(Y/N)") | field.contains("(T/F)") | (value.isin("0", "1") & ~id_like), "BINARY")
            .otherwise("STANDARD"))


# --- fixed values: marks of an embedded structure; a repeated mark counts again ------
DICT_MARKS = ["{'", '{"', "': ", '": ', "': {", '": {', "': [", '": [', "':", '":', "}, ", "}, ", "], ", "], "]
LIST_MARKS = ["[{", "{'", '["', "['"]
NESTED_MARKS = ["{'", '{"', "[{", "[[", "{{", "':", '":', "}: ", "}: ", "]: ", "]: "]


def is_complex(c: Column) -> Column:
    """Whether a text value looks like an embedded dict or list."""
    v = F.trim(c)

    def marks(items: list[str]) -> Column:
        return reduce(lambda a, b: a + b, [v.contains(m).cast("int") for m in items])

    braces = F.filter(F.split(F.regexp_replace(v, r"[^{}]", ""), ""), lambda s: s != "")
    deepest = F.aggregate(
        braces, F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")),
        lambda acc, s: F.struct((acc["now"] + F.when(s == "{", 1).otherwise(-1)).alias("now"),
                                F.greatest(acc["top"], acc["now"] + F.when(s == "{", 1).otherwise(-1)).alias("top")),
        lambda acc: acc["top"])
    found = ((marks(DICT_MARKS) >= 3) | (marks(LIST_MARKS) >= 2) | (marks(NESTED_MARKS) >= 4)
             | (v.startswith("{") & v.contains(":") & (deepest > 1)) | (v.startswith("[") & v.contains("{")))
    return F.coalesce((F.length(v) >= 10) & found, F.lit(False))


def complex_columns(df: DataFrame) -> DataFrame:
    """Text columns with their number of embedded-structure values, one aggregate."""
    names = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    counts = df.agg(*[F.count_if(is_complex(F.col(n))).alias(n) for n in names])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("n_complex"))
                                            for n in names])))


def natural_name(field: Column) -> Column:
    return F.trim(F.replace(F.replace(field, F.lit("(Y/N)"), F.lit("")), F.lit("(T/F)"), F.lit("")))


def is_binary_field(field: Column, value: Column) -> Column:
    return F.coalesce(field.contains("(Y/N)") | field.contains("(T/F)") | value.isin("0", "1"), F.lit(False))


def first_non_null(long: DataFrame) -> DataFrame:
    """First filled value per field in row order, else ``Sample_<field>``."""
    filled = F.when(~T.is_null_word(F.col("value"), vocab.NULL_WORDS_PROFILE), F.struct("row_id", "value"))
    return (long.groupBy("field").agg(F.min(filled).alias("m"))
            .select("field", F.coalesce("m.value", F.concat(F.lit("Sample_"), "field")).alias("value")))


def document_domain(text: Column, fields: list[str], head_chars: int | None = None) -> Column:
    """``<domain> data report`` by keyword counts in the text and the field names.

    The whole text counts by default; ``head_chars`` limits it to its beginning.
    """
    names = [f.lower() for f in fields]

    def name_of(low: Column) -> Column:
        def hits(word: str) -> Column:
            return ((F.length(low) - F.length(F.replace(low, F.lit(word), F.lit("")))) / len(word)).cast("int")
        scores = [F.struct((reduce(lambda a, b: a + b, [hits(w) for w in words])
                            + sum(w in n for w in words for n in names)).alias("score"),
                           F.lit(-i).alias("rank"), F.lit(domain).alias("domain"))
                  for i, (domain, words) in enumerate(DOMAIN_KEYWORDS.items())]
        return T.let(F.greatest(*scores), lambda b: F.when(b["score"] > 0, b["domain"]).otherwise("professional"))

    low = F.lower(F.substring(text, 1, head_chars) if head_chars else text)
    return F.concat(T.let(low, name_of), F.lit(" data report"))


def describe_columns(columns: DataFrame, enhanced: DataFrame, base: DataFrame) -> DataFrame:
    """Descriptor per column: enhanced, else base, else the stated fallback text."""
    keys = ["table_name", "column_name"]
    e = enhanced.select(*keys, F.nullif(F.trim("descriptor"), F.lit("")).alias("_e"))
    b = base.select(*keys, F.nullif(F.trim("descriptor"), F.lit("")).alias("_b"))
    fallback = F.concat(F.lit("Data field representing "), F.col("column_name"), F.lit(" information."))
    return (columns.join(e, keys, "left").join(b, keys, "left")
            .withColumn("origin", F.when(F.col("_e").isNotNull(), "enhanced")
                        .when(F.col("_b").isNotNull(), "base").otherwise("fallback"))
            .withColumn("descriptor", F.coalesce("_e", "_b", fallback)).drop("_e", "_b"))


def common_word_values(values: DataFrame, documents: DataFrame, text_col: str, share: float) -> DataFrame:
    """Flag one-word values found in at least ``share`` of the documents.

    Document words are cut down to the candidate words before counting.
    """
    wanted = values.select(F.lower("value").alias("word")).distinct()
    seen = (documents.select(F.explode(T.word_set(F.col(text_col))).alias("word"))
            .join(wanted, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n_docs")))
    total = documents.agg(F.count("*").alias("n_all"))
    return (values.join(seen, F.lower("value") == F.col("word"), "left").drop("word")
            .withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
            .withColumn("is_common", F.col("n_docs") >= F.lit(share) * total.scalar()))
