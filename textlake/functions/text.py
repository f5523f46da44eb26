"""Column functions over text. Every function takes and returns a Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from textlake import vocab

_SPACE = r"[\s\p{Z}]+"
_NOT_WORD = r"[^\p{L}\p{N}_]+"


def let(c: Column, body) -> Column:
    """``body`` of a column that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def squeeze(c: Column) -> Column:
    """Collapse runs of white space and trim."""
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def number_format(c: Column, decimals: int, grouped: bool = False) -> Column:
    """Fixed-decimal text of a double, half-even on the exact binary value."""
    pattern = ("#,##0" if grouped else "0") + ("." + "0" * decimals if decimals else "")
    return F.call_function("format_number", c, F.lit(pattern))


def to_number(c: Column) -> Column:
    """Double for text that is a plain decimal number, else NULL."""
    return F.when(c.rlike(vocab.NUMBER), F.trim(c).try_cast("double"))


def clean_field_string(c: Column) -> Column:
    no_tags = F.regexp_replace(c, r"<[^>]+>", "")
    return squeeze(F.translate(F.translate(no_tags, "\\/", "  "), "\"'`", ""))


def clean_model_response(c: Column) -> Column:
    bare = F.regexp_replace(F.trim(c), "^[\"'`]+|[\"'`]+$", "")
    no_star = F.replace(bare, F.lit("*"), F.lit(""))
    no_fence = F.regexp_replace(no_star, "```[^`]*```", "")
    return squeeze(F.coalesce(F.regexp_replace(no_fence, "`([^`]*)`", "$1"), F.lit("")))


def count_placeholders(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\[[^\]]+\]"))


def strip_tags(c: Column) -> Column:
    """Drop every sentence tag and pipe delimiter."""
    return F.replace(F.regexp_replace(c, r"\s*\(Hash:\s*[a-f0-9]+\)", ""), F.lit("|"), F.lit(""))


def is_null_word(c: Column, words: list[str] = vocab.NULL_WORDS_RENDER) -> Column:
    return c.isNull() | F.upper(F.trim(c)).isin(words)


def is_true_word(c: Column) -> Column:
    return F.coalesce(F.upper(F.trim(c)).isin(vocab.TRUE_WORDS), F.lit(False))


def is_false_word(c: Column) -> Column:
    return F.coalesce(F.upper(F.trim(c)).isin(vocab.FALSE_WORDS), F.lit(False))


def plain_number(x: Column, text: Column) -> Column:
    """Text of a number without useless decimals; ``text`` when it is no number."""
    return (F.when(x.isNull(), text)
            .when(x == F.floor(x), F.when(x == 0, F.lit("0")).otherwise(number_format(x, 0)))
            .otherwise(number_format(x, 2)))


def is_percent(field: str) -> bool:
    return "percent" in field.lower() or "%" in field


def number_text(field: str, x: Column, text: Column, style: str = "render") -> Column:
    """Text of a value whose number is already read into ``x``."""
    plain = plain_number(x, text)
    if not is_percent(field):
        return plain
    scaled = F.when(x.between(0, 1), x * 100).when(x > 1, x)
    if style == "raw":
        shown = F.concat(plain_number(scaled, text), F.lit("%"))
    else:
        shown = F.concat(number_format(scaled, 1 if style == "render" else 2), F.lit("%"))
    return F.when(scaled.isNotNull(), shown).otherwise(plain)


def format_value(field: str, c: Column, style: str = "render") -> Column:
    """Text of a value inside a sentence.

    ``style`` decides percent fields: ``render`` one decimal and ``%``, ``raw`` the
    number and ``%``, ``sentence`` two decimals and ``%``. NULL reads ``NULL``.
    """
    text = F.coalesce(c.cast("string"), F.lit("NULL"))
    return let(F.struct(text.alias("t"), to_number(text).alias("x")),
               lambda v: number_text(field, v["x"], v["t"], style))


def format_column_value(field: str, c: Column, null_mode: str = "explicit") -> Column:
    """As ``format_value`` in sentence style; missing words follow the mode, leading zeros stay."""
    text = F.coalesce(c.cast("string"), F.lit("NULL"))
    missing = F.lit("NULL" if null_mode == "explicit" else "not specified")
    formatted = format_value(field, text, style="sentence")
    if not is_percent(field):
        keep = text.startswith("0") & ~text.contains(".")
        formatted = F.when(keep, text).otherwise(formatted)
    return F.when(F.upper(text).isin(vocab.NULL_WORDS_SENTENCE), missing).otherwise(formatted)


def humanize_column(c: Column) -> Column:
    """``t1.customer_id`` reads ``customer id``."""
    return F.trim(F.replace(F.substring_index(c, ".", -1), F.lit("_"), F.lit(" ")))


def humanize_date(c: Column) -> Column:
    """``201309``, ``2012-08-24``, ``1981-11-`` and ``1996-01`` with month names; else unchanged."""
    text = F.trim(c)
    months = F.array(*[F.lit(m) for m in vocab.MONTHS])

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group)

    compact = r"^(\d{4})(0[1-9]|1[0-2])$"
    full = r"^(\d{4})-(0[1-9]|1[0-2])-(\d{2})$"
    short = r"^(\d{4})-(0[1-9]|1[0-2])-?$"

    def month(pattern: str) -> Column:
        return F.element_at(months, part(pattern, 2).cast("int"))

    return (F.when(text.rlike(full),
                   F.concat(month(full), F.lit(" "), part(full, 3).cast("int").cast("string"),
                            F.lit(", "), part(full, 1)))
            .when(text.rlike(short), F.concat(month(short), F.lit(" "), part(short, 1)))
            .when(text.rlike(compact), F.concat(month(compact), F.lit(" "), part(compact, 1)))
            .otherwise(text))


def _strip_char(c: Column, ch: str, left: bool = True, right: bool = True) -> Column:
    alternatives = ([f"^{ch}+"] if left else []) + ([f"{ch}+$"] if right else [])
    return F.regexp_replace(c, "|".join(alternatives), "")


def like_text(col: Column, pattern: Column, negate: Column) -> Column:
    """Wording of a LIKE predicate."""
    subject = F.concat(F.lit("The "), humanize_column(col), F.lit(" "))
    head = _strip_char(pattern, "%", left=False)
    dated = humanize_date(head)

    def verb(positive: str, negative: str) -> Column:
        return F.when(negate, F.lit(negative)).otherwise(F.lit(positive))

    return (F.when(pattern.startswith("%") & pattern.endswith("%"),
                   F.concat(subject, verb("mentions ", "does not mention "),
                            humanize_date(_strip_char(pattern, "%"))))
            .when(pattern.endswith("%") & (dated != head),
                  F.concat(subject, verb("is in ", "is not in "), dated))
            .when(pattern.endswith("%"), F.concat(subject, F.lit("starts with "), head))
            .when(pattern.startswith("%"),
                  F.concat(subject, F.lit("ends with "),
                           humanize_date(_strip_char(pattern, "%", right=False))))
            .otherwise(F.concat(subject, verb("is like ", "is not like "), humanize_date(pattern))))


COMPARISON_TEXT = {">=": "is greater than or equal to", "<=": "is less than or equal to",
                   "<>": "is not", "!=": "is not", ">": "is greater than",
                   "<": "is less than", "=": "is"}
CONDITION_TEXT = {"=": "is", "!=": "is not", "<>": "is not", ">": "is greater than",
                  "<": "is less than", ">=": "is at least", "<=": "is at most",
                  "LIKE": "contains", "NOT LIKE": "does not contain",
                  "IN": "is one of", "NOT IN": "is not one of"}


def predicate_text(op: Column, col: Column, v1: Column, v2: Column) -> Column:
    """One sentence per structured predicate."""
    subject = F.concat(F.lit("The "), humanize_column(col), F.lit(" "))
    d1, d2 = humanize_date(v1), humanize_date(v2)
    text = (F.when(op == "IS NOT NULL", F.concat(subject, F.lit("has a value")))
            .when(op == "IS NULL", F.concat(subject, F.lit("is absent")))
            .when(op == "NOT BETWEEN",
                  F.concat(subject, F.lit("is not between "), d1, F.lit(" and "), d2))
            .when(op == "BETWEEN", F.concat(subject, F.lit("is between "), d1, F.lit(" and "), d2))
            .when(op.isin("LIKE", "NOT LIKE"), like_text(col, v1, op == "NOT LIKE"))
            .when(op == "NOT IN", F.concat(subject, F.lit("is not in ("), v1, F.lit(")")))
            .when(op == "IN", F.concat(subject, F.lit("is in ("), v1, F.lit(")"))))
    for symbol, words in COMPARISON_TEXT.items():
        text = text.when(op == symbol, F.concat(subject, F.lit(words + " "), d1))
    return text


def condition_text(op: Column, col: Column, value: Column) -> Column:
    """Shorter wording used in step instructions."""
    words = reduce(lambda w, kv: w.when(F.upper(op) == kv[0], F.lit(kv[1])),
                   CONDITION_TEXT.items(), F.when(F.lit(False), F.lit("")))
    return F.concat(F.lit("The "), humanize_column(col), F.lit(" "),
                    F.coalesce(words, F.upper(op)), F.lit(" "), value)


def step_text(op_type: Column, col: Column, op: Column, v1: Column, func: Column,
              k: Column, ascending: Column, right_col: Column) -> Column:
    """Instruction of one step: filter, join, group, aggregate, extract or top-k."""
    name = humanize_column(col)
    agg = (F.when(F.lower(func) == "count", F.concat(F.lit("The total count of "), name))
           .otherwise(F.concat(F.lit("The "), F.lower(func), F.lit(" of "), name)))
    topk = (F.when(k == 1, F.concat(F.lit("The one with "),
                                    F.when(ascending, F.lit("lowest ")).otherwise(F.lit("highest ")),
                                    name))
            .otherwise(F.concat(F.lit("Top "), k.cast("string"), F.lit(" by "), name,
                                F.when(ascending, F.lit(" ascending")).otherwise(F.lit(" descending")))))
    return (F.when(op_type == "sem_filter", condition_text(op, col, v1))
            .when(op_type == "sem_join",
                  F.concat(F.lit("The "), name, F.lit(" described in one document is the same as the "),
                           humanize_column(right_col), F.lit(" described in the other document.")))
            .when(op_type == "sem_cluster_by", F.concat(F.lit("Group by "), name))
            .when(op_type == "sem_agg", agg)
            .when(op_type == "sem_extract", F.concat(F.lit("The "), name))
            .when(op_type == "sem_topk", topk)
            .when(op_type == "subquery_result", F.concat(F.lit("Use subquery result "), v1))
            .otherwise(v1))


def clean_predicate(c: Column) -> Column:
    """Drop type casts and one outer pair of parentheses, squeeze spaces."""
    no_cast = F.regexp_replace(
        c, r"(?i)::(?:text|integer|bigint|real|float|numeric|boolean|date|timestamp)\b", "")
    flat = squeeze(no_cast)
    return F.when(flat.rlike(r"^\(.+\)$"), F.trim(F.regexp_replace(flat, r"^\((.+)\)$", "$1"))).otherwise(flat)


def is_raw_sql_text(c: Column) -> Column:
    """Whether an instruction still holds leftover SQL."""
    found = (c.rlike(r"(?i)\b(?:STRFTIME|SUBSTR|JULIANDAY)\s*\(") | c.contains("`")
             | c.rlike(r"\b[A-Za-z]\w*\.[A-Za-z]") | c.rlike(r"\bOR\b") | c.rlike(r"_[:%]|__\.")
             | (F.regexp_count(c, F.lit(r"\)")) > F.regexp_count(c, F.lit(r"\("))))
    return F.coalesce(found, F.lit(False))


# lower-case marks of a sentence that clean_sentence may change
_CLEAN_MARKS = ["|", "(hash:", "  ", "row value for", "indicates that", "the value", "recorded as", "name",
                "percent (", "count (", "enrollment ("]


def _may_change(c: Column) -> Column:
    """Cheap test that spares most sentences the full rewrite; any other character than plain ASCII passes it."""
    marked = let(F.lower(c), lambda low: reduce(lambda a, b: a | b, [low.contains(m) for m in _CLEAN_MARKS]))
    return (F.length(c) != F.octet_length(c)) | marked | c.rlike(r"[\x00-\x1f]")


def clean_sentence(c: Column) -> Column:
    """Strip tags, rewrite data-like phrases, squeeze spaces and close the sentence."""
    text = strip_tags(c)
    for pattern, words in vocab.CLEANUPS:
        text = F.regexp_replace(text, "(?i)" + pattern, words)
    cleaned = F.when(_may_change(c), squeeze(text)).otherwise(F.trim(c))

    def closed(t: Column) -> Column:
        full = F.regexp_replace(F.regexp_replace(t, r"([^.!?])$", "$1."), r"\.\.$", ".")
        return F.when(t.endswith(".") & ~t.endswith(".."), t).otherwise(full)  # most sentences are closed already
    return let(cleaned, closed)


def clean_malformed_variation(c: Column) -> Column:
    """Repair percent placeholders and dangling commas in a generated wording."""
    rules = [
        (r"([A-Za-z\s]+),\s+which\s+is\s+\[PLACEHOLDER\]%", "$1 is [PLACEHOLDER]%"),
        (r"(?i)\bnot\s+specified%", "not specified"),
        (r"([A-Za-z\s]+),\s+\[PLACEHOLDER\]%", "$1 is [PLACEHOLDER]%"),
        (r"([A-Za-z\s]+)\s+which\s+is\s+\[PLACEHOLDER\]%", "$1 is [PLACEHOLDER]%"),
        (r"\bwhich\s+is\s+(\[PLACEHOLDER\]%)", "is $1"),
        (_SPACE, " "),
        (r"\s*,\s*$", ""),
        (r"\s*,\s*\.", "."),
    ]
    return F.trim(reduce(lambda text, r: F.regexp_replace(text, r[0], r[1]), rules, c))


def split_sentences(c: Column, min_length: int = 10) -> Column:
    """Sentences of plain text: split at ``!``, ``?`` and periods that touch no digit."""
    parts = F.transform(F.split(c, r"(?<!\d)\.(?!\d)|[!?]+"), lambda s: _strip(s))
    return F.filter(parts, lambda s: F.length(s) > min_length)


def _strip(s: Column) -> Column:
    return F.regexp_replace(s, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


_HEADERS = ("generated narrative|narrative variation|document #|variation|report|template"
            "|example|sample")


def split_narrative(c: Column) -> Column:
    """Sentences of a tagged narrative.

    Header and rule lines are skipped; pipe segments win when there are two pipes;
    a period before a tag does not end a sentence.
    """
    lines = F.transform(F.split(c, "\n"), lambda s: _strip(s))
    kept = F.filter(lines, lambda s: (s != "") & ~s.rlike("^[=_-]")
                    & ~(F.lower(s).rlike(_HEADERS) & (F.length(s) < 100)))
    text = F.array_join(kept, " ")
    parts = F.when(F.regexp_count(text, F.lit(r"\|")) >= 2, F.split(text, r"\|")).otherwise(
        F.split(text, r"(?<!\d)\.(?!\d)(?!\s*\(Hash:)|[!?]+"))
    return F.filter(F.transform(parts, lambda s: _strip(s)), lambda s: s != "")


def parse_numbered_list(c: Column, cap: int | None = None) -> Column:
    """Sentences of a model answer that lists one per line."""
    lines = F.transform(F.split(c, "\n"), lambda s: _strip(s))
    bare = F.transform(lines, lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(
        s, r"^\d+[.)]\s*", ""), r"^[-•*]\s*", ""), r"^Variation \d+:?\s*", ""))
    kept = F.filter(bare, lambda s: F.length(s) > 10)
    return F.slice(kept, 1, cap) if cap else kept


def parse_numbered_segments(c: Column) -> Column:
    """Numbered lines of a model answer as pipe-delimited segments."""
    lines = F.transform(F.split(c, "\n"), lambda s: _strip(s))
    numbered = F.filter(lines, lambda s: s.rlike(r"^\d+[.)]\s*.+$"))
    return F.array_join(F.transform(numbered, lambda s: F.concat(
        F.lit("| "), _strip(F.regexp_replace(s, r"^\d+[.)]\s*", "")), F.lit(" |"))), " ")


def word_set(c: Column) -> Column:
    """Distinct lower-case words longer than two characters."""
    words = F.split(F.lower(c), _NOT_WORD)
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))


def estimate_tokens(c: Column) -> Column:
    return F.coalesce(F.floor(F.length(c) / 4), F.lit(0)).cast("bigint")


def detection_phrases(null_mode: str, binary_mode: str) -> dict[str, list[str]]:
    """Phrase lists of a mode pair; implicit lists include the explicit words."""
    explicit_null, explicit_binary = null_mode == "explicit", binary_mode == "explicit"
    return {
        "null": (vocab.EXPLICIT_NULL_PHRASES if explicit_null
                 else vocab.IMPLICIT_NULL_PHRASES + vocab.EXPLICIT_NULL_PHRASES),
        "true": (vocab.EXPLICIT_TRUE_PHRASES if explicit_binary
                 else vocab.IMPLICIT_TRUE_PHRASES + vocab.EXPLICIT_TRUE_PHRASES),
        "false": (vocab.EXPLICIT_FALSE_PHRASES if explicit_binary
                  else vocab.IMPLICIT_FALSE_PHRASES + vocab.EXPLICIT_FALSE_PHRASES),
    }


def holds_phrase(c: Column, phrases: list[str]) -> Column:
    """Whether the lower-cased text holds one of the phrases; one that holds a shorter one of them needs no search."""
    least = sorted((p for p in set(phrases) if not any(q != p and q in p for q in phrases)), key=lambda p: (len(p), p))
    return let(F.lower(c), lambda low: F.exists(F.array(*[F.lit(p) for p in least]), lambda p: F.contains(low, p)))


def is_misc(c: Column) -> Column:
    """Non-empty text made of punctuation and symbols only."""
    chars = "".join("\\" + ch if ord(ch) < 128 else ch for ch in vocab.MISC_CHARACTERS)
    return F.coalesce((F.trim(c) != "") & c.rlike(rf"^[{chars}\s]+$"), F.lit(False))


def is_date(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(vocab.DATE_STARTS), F.lit(False))


# --- answers ----------------------------------------------------------------------

def normalize_answer(answers: Column) -> Column:
    """Sorted lower-case tokens of an array of answers."""
    tokens = F.regexp_extract_all(F.lower(F.array_join(answers, " ")), F.lit("[a-z0-9]+"), F.lit(0))
    return F.coalesce(F.array_join(F.array_sort(tokens), " "), F.lit(""))


def numbers_in(answers: Column) -> Column:
    """Every number written in an array of answers."""
    found = F.regexp_extract_all(F.array_join(answers, " "),
                                 F.lit(r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"), F.lit(0))
    return F.transform(found, lambda s: s.try_cast("double"))


def answers_match(extracted: Column, truth: Column, tolerance: float = 0.01) -> Column:
    """Same tokens, or every true number within ``tolerance`` of an extracted one."""
    no_truth = F.coalesce(F.size(truth) <= 0, F.lit(True))
    no_answer = F.coalesce(F.size(extracted) <= 0, F.lit(True))
    got, want = numbers_in(extracted), numbers_in(truth)
    close = F.forall(want, lambda g: F.exists(got, lambda e: F.abs(e - g) <= tolerance))
    return (F.when(no_truth, no_answer)
            .otherwise((normalize_answer(extracted) == normalize_answer(truth))
                       | (F.coalesce((F.size(want) > 0) & (F.size(got) > 0) & close, F.lit(False)))))


SQL_FUNCTIONS = {
    "tl_strip_tags(x STRING) RETURNS STRING":
        r"replace(regexp_replace(x, '\\s*\\(Hash:\\s*[a-f0-9]+\\)', ''), '|', '')",
    "tl_humanize_column(x STRING) RETURNS STRING":
        "trim(replace(substring_index(x, '.', -1), '_', ' '))",
    "tl_count_placeholders(x STRING) RETURNS INT":
        r"regexp_count(x, '\\[[^\\]]+\\]')",
    "tl_estimate_tokens(x STRING) RETURNS BIGINT":
        "coalesce(floor(length(x) / 4), 0)",
    "tl_normalize_answer(x ARRAY<STRING>) RETURNS STRING":
        "coalesce(array_join(array_sort(regexp_extract_all(lower(array_join(x, ' ')), '[a-z0-9]+', 0)), ' '), '')",
}


def register(spark: SparkSession) -> list[str]:
    """Expose text functions to SQL users as temporary SQL functions (no Python at run time)."""
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [signature.split("(")[0] for signature in SQL_FUNCTIONS]
