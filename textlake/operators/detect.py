"""Finding field names and values in sentences.

Patterns are built as columns (quoted literals), so each rule is a JVM expression over
one (sentence, field, value) row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake import vocab
from textlake.functions import text as X
from textlake.operators.model import RowModel, model_map
from textlake.operators.render import append_tag, extract_tag, strip_tag
from textlake.session import by_shuffle

# a value stands alone when white space or punctuation other than '-' is on both sides
EDGE = r"[\s!-,./:-@\[-`{-~]"
BEFORE, AFTER = rf"(?:^|(?<={EDGE}))", rf"(?=$|{EDGE})"
STRICT = r"[\s,.:;!?()\"'\-]"


def quoted(c: Column) -> Column:
    """A column as a regex literal."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _rx(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def bounded(value: Column) -> Column:
    return _rx("(?i)" + BEFORE, quoted(value), AFTER)


def has_strict(sentence: Column, value: Column) -> Column:
    """Whether a value is a standalone token of the sentence."""
    v = F.trim(value)
    return F.coalesce((v != "") & F.rlike(sentence, _rx(rf"(?i)(?:^|(?<={STRICT}))", quoted(v), rf"(?={STRICT}|$)")),
                      F.lit(False))


def has_value(sentence: Column, value: Column) -> Column:
    return F.coalesce((value != "") & F.contains(F.lower(sentence), F.lower(value)), F.lit(False))


def _literal_repl(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\$])", r"\\$1")


# --- names -------------------------------------------------------------------------

def _plural(n: Column) -> Column:
    return (F.when(n.endswith("y"), F.concat(F.substring(n, F.lit(1), F.length(n) - 1), F.lit("ies")))
            .when(n.rlike("(?:s|sh|ch|x|z)$"), F.concat(n, F.lit("es"))).otherwise(F.concat(n, F.lit("s"))))


def name_forms(field: Column) -> Column:
    """Spellings of a field name: as is, cleaned, without parentheses, and their plurals."""
    clean = X.clean_field_string(field)
    clean = F.when(F.length(clean) < 2, field).otherwise(clean)

    def bare(c: Column) -> Column:
        return F.trim(F.translate(c, "()", ""))
    forms = F.array_distinct(F.array(field, bare(field), bare(clean)))
    return F.flatten(F.transform(forms, lambda n: F.array(n, _plural(n))))


def has_name(sentence: Column, field: Column) -> Column:
    """A spelling of the name as whole words, an ending ``'s`` allowed."""
    return F.exists(name_forms(field), lambda n: F.rlike(sentence, _rx(
        "(?i)(?:\\b", quoted(n), "'?s?\\b|" + BEFORE, quoted(n), "'?s?" + AFTER + ")")))


def has_name_words(sentence: Column, field: Column) -> Column:
    """Every longer word of a many-word name, anywhere in the sentence."""
    words = F.filter(F.transform(F.split(F.trim(X.clean_field_string(field)), r"\s+"),
                                 lambda w: F.regexp_replace(w, r"^[()]+|[()]+$", "")), lambda w: F.length(w) > 2)
    many = F.size(F.split(F.trim(field), r"\s+")) > 1
    return many & F.forall(words, lambda w: F.rlike(sentence, _rx(r"(?i)(?<!\w)", quoted(w), r"(?!\w)")))


def mask_numbered_names(sentence: Column, names: list[str]) -> Column:
    """Blank out phrases of field names that hold a digit, so that their digits are not taken for values."""
    import re
    for name in names:
        words = name.split()
        for i, w in enumerate(words):
            if any(ch.isdigit() for ch in w):
                for phrase in (words[max(0, i - 1):i + 1], words[i:i + 2]):
                    if len(phrase) > 1 or not w.isdigit():
                        rx = r"(?i)(?<!\w)" + r"\s+".join(re.escape(p) for p in phrase) + r"(?!\w)"
                        sentence = F.regexp_replace(sentence, rx, " ")
    return sentence


def _has_plain_value(sentence: Column, value: Column, names: list[str]) -> Column:
    x = F.when(value.rlike(r"^\d*\.?\d+$|^\d+\.$"), value.try_cast("double"))
    whole = x == F.floor(x)
    forms = F.array_compact(F.array(
        value, F.when(whole, X.number_format(x, 0)), F.when(whole & (x >= 1000), X.number_format(x, 0, True)),
        F.when((x > 0) & (x < 1), F.concat(X.number_format(x * 100, 2), F.lit("%"))),
        F.when(x.isNull(), F.trim(F.translate(value, "()", "")))))
    where = F.when(x.isNotNull(), mask_numbered_names(sentence, names)).otherwise(sentence)
    return F.coalesce(value != "", F.lit(False)) & F.exists(forms, lambda v: (v != "") & F.rlike(where, bounded(v)))


def name_in_sentence(sentence: Column, field: Column, value: Column, names: list[str] | None = None) -> Column:
    """Strongest way a field shows in a sentence, empty when it does not."""
    return (F.when(has_name(sentence, field), "field_name_direct")
            .when(has_name_words(sentence, field), "field_name_word_by_word")
            .when(_has_plain_value(sentence, X.clean_field_string(value), names or []), "field_value")
            .otherwise(""))


# --- values ------------------------------------------------------------------------

_TRAIL = "[!-/:-@\\[-`{-~]+$"


def value_variants(value: Column) -> Column:
    """Texts that may stand for a value in prose, best first."""
    numeric = value.rlike(r"^-?\d+\.?\d*$|^-?\d*\.\d+$")
    return F.when(numeric, X.let(value.try_cast("double"), lambda x: _number_variants(value, x))).otherwise(
        _text_variants(value))


def _number_variants(value: Column, x: Column) -> Column:
    whole = x == F.floor(x)
    i = F.when(whole, X.number_format(x, 0))
    last2, last = F.pmod(x.cast("bigint"), F.lit(100)), F.pmod(x.cast("bigint"), F.lit(10))
    suffix = (F.when(last2.between(10, 20), "th").when(last == 1, "st").when(last == 2, "nd")
              .when(last == 3, "rd").otherwise("th"))
    numbers = [value, i, F.when(whole & (x >= 0), F.concat(i, suffix)),
               F.when(whole & (F.abs(x) >= 1000), X.number_format(x, 0, True))]
    dotted = value.contains(".")
    for d in range(1, 11):
        numbers += [F.when(dotted, X.number_format(x, d)),
                    F.when(dotted, F.call_function("format_number", x, F.lit("0.0" + "#" * (d - 1))))]
    share = (F.abs(x) > 0) & (F.abs(x) < 1)
    for d in range(5):
        p = F.when(share, X.number_format(x * 100, d))
        numbers += [F.concat(p, F.lit("%")), p]
    return F.array_distinct(F.array_compact(F.array(*numbers)))


def _text_variants(value: Column) -> Column:
    clean = X.clean_field_string(value)

    def cut(c: Column) -> Column:
        short = F.regexp_replace(c, _TRAIL, "")
        return F.when((short != c) & (F.length(short) > 2), short)

    commas = F.length(value) - F.length(F.replace(value, F.lit(","), F.lit("")))
    parts = F.split(value, ",")
    head = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), ", ")
    tail = F.element_at(parts, -1)

    def all_joined(word: str) -> Column:
        return X.squeeze(F.replace(value, F.lit(","), F.lit(f" {word} ")))

    def listed(glue: str) -> Column:
        return F.when(commas >= 2, X.squeeze(F.concat(head, F.lit(glue), tail)))

    one = [F.when(commas == 1, all_joined(w)) for w in ("and", "or")]
    many = [listed(g) for g in (" and ", ", and ", " or ", ", or ")]
    every = [F.when(commas >= 2, all_joined(w)) for w in ("and", "or")]
    spaced = F.when(commas >= 1, X.squeeze(F.replace(value, F.lit(","), F.lit(", "))))
    parens = value.contains("(") & value.contains(")")
    open_text = F.when(parens, X.squeeze(F.translate(value, "()", "  ")))
    outside = F.when(parens, F.trim(F.regexp_replace(value, r"\s*\([^)]*\)", "")))
    outside = F.when(F.length(outside) > 2, outside)
    items = [value, clean, cut(value), cut(clean), *one, *[cut(c) for c in one], *many, *every, *[cut(c) for c in many],
             spaced, open_text, cut(open_text), outside, cut(outside)]
    return F.filter(F.array_distinct(F.array_compact(F.array(*items))), lambda v: v != "")


# --- the cascade -------------------------------------------------------------------

def _first_match(text: Column, regexes: list[Column | str]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, r, 0) if isinstance(r, str)
                                 else F.regexp_substr(text, r), F.lit("")) for r in regexes])


def _first_phrase(low: Column, phrases: list[str]) -> Column:
    return F.coalesce(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in phrases])


def _binary_text(sentence: Column, field: Column, value: Column) -> Column:
    """Text that shows a 0/1 value: the digit, a yes/no word, or "is a / is not" the field."""
    low = F.lower(sentence)
    name = quoted(F.trim(F.lower(F.replace(F.replace(field, F.lit("(Y/N)"), F.lit("")), F.lit("(T/F)"), F.lit("")))))
    end = r"(?=\s|$|[^\w])"
    digit = F.regexp_substr(sentence, _rx(r"(?:^|(?<=\s))", quoted(value), r"(?=$|[\s,.:;!?])"))
    yes = _first_match(low, [r"\byes\b", r"\btrue\b", r"\bactive\b", r"\benabled\b",
                             _rx(r"(?:as\s+a|is\s+a|is\s+an)\s+", name, end),
                             _rx(r"operating\s+(?:as\s+)?(?:a\s+|an\s+)?", name, end)])
    no = _first_match(low, [r"\bno\b", r"\bfalse\b", r"\binactive\b", r"\bdisabled\b",
                            _rx(r"(?:\w+\s+)*is\s+not\s+(?:a\s+|an\s+)?", name, r"(?:\s+\w+)*"),
                            _rx(r"(?:\w+\s+)*not\s+(?:a\s+|an\s+)?", name, r"(?:\s+\w+)*")])
    return F.coalesce(digit, F.when(value == "1", yes).otherwise(no))


def _misc_text(sentence: Column, value: Column, named: Column) -> Column:
    low = F.lower(sentence)
    def words(table: dict[str, list[str]]) -> Column:
        chain = F.when(F.lit(False), F.lit(""))
        for mark, names in table.items():
            chain = chain.when(value == mark, _first_phrase(low, names))
        return chain
    literal = F.when(F.contains(sentence, value), value)
    return F.coalesce(literal, F.when(named, words(vocab.MISC_WORDS_NAMED)).otherwise(words(vocab.MISC_WORDS)))


def _standard_text(sentence: Column, value: Column) -> Column:
    one_digit = value.rlike(r"^\d$")
    alone = F.regexp_substr(sentence, _rx(r"(?:^|(?<=\s))", quoted(value), r"(?=$|\s)"))
    # the value itself is the best variant, so the others are only built when it is not there
    hit = F.coalesce(F.when(F.rlike(sentence, bounded(value)) & (value != ""), value), F.get(
        F.filter(value_variants(value), lambda v: F.rlike(sentence, bounded(v))), F.lit(0)))
    return F.when(one_digit, alone).otherwise(X.let(hit, lambda h: F.regexp_substr(sentence, bounded(h))))


def field_in_sentence(sentence: Column, field: Column, value: Column, klass: Column,
                      names: list[str] | None = None) -> Column:
    """``(found, matched_text, match_type)`` of a field in a sentence, by the rules of its class."""
    missing = (F.upper(value).isin("NULL", "NONE")) | (F.trim(value) == "")
    binary = (klass.isin("BINARY", "NULLABLE_BINARY")) & value.isin("0", "1")
    low = F.lower(sentence)

    def text_of(kind: Column) -> Column:
        named = kind.startswith("field_name")
        return (F.when(binary, _binary_text(sentence, field, value))
                .when((klass.isin("NULL", "NULLABLE_BINARY")) & missing, F.when(named, F.coalesce(
                    _first_phrase(low, vocab.NAMED_NULL_PHRASES), F.lit("not specified"))).otherwise(
                    _first_phrase(low, vocab.UNNAMED_NULL_PHRASES)))
                .when((klass == "MISC") & X.is_misc(value), _misc_text(sentence, value, named))
                .otherwise(_standard_text(sentence, value)))

    def judge(kind: Column) -> Column:
        text = F.when(kind != "", text_of(kind))
        return F.struct(kind.alias("kind"), text.alias("text"))

    def verdict(j: Column) -> Column:
        found = (j["kind"] != "") & (j["kind"].startswith("field_name") | j["text"].isNotNull())
        return F.struct(found.alias("found"), F.coalesce(j["text"], value).alias("matched_text"),
                        F.when(found, j["kind"]).otherwise("").alias("match_type"))

    return X.let(X.let(name_in_sentence(sentence, field, value, names), judge), verdict)


def replace_match(sentence: Column, field: Column, matched: Column) -> Column:
    """Sentence with the first occurrence of the matched text replaced by the field's mark, NULL when it fails."""
    mark = F.concat(F.lit("["), F.replace(F.upper(field), F.lit(" "), F.lit("_")), F.lit("]"))

    def first(rx: Column) -> Column:
        out = F.regexp_replace(sentence, rx, F.concat(F.lit("$1"), _literal_repl(mark)))
        return F.when(out != sentence, out)
    usable = F.coalesce((matched != "") & ~matched.isin("[ERROR]", "[FIELD_NAME_ONLY]"), F.lit(False))
    return F.when(usable, F.coalesce(
        first(_rx("(?is)^(.*?)" + BEFORE, quoted(matched), AFTER)),
        first(_rx("(?s)^(.*?)", quoted(matched))), first(_rx("(?is)^(.*?)", quoted(matched)))))


def templatize(sentence: Column, field: Column, value: Column) -> Column:
    """Sentence with every standalone value replaced by ``[FIELD]``, except inside the field's own name.

    The text is cut at occurrences of the name; values are replaced in the pieces between.
    """
    mark = _literal_repl(F.concat(F.lit("["), F.upper(field), F.lit("]")))
    tokens = F.split(F.trim(F.replace(field, F.lit("_"), F.lit(" "))), r"\s+")
    glue = r"[\s!-,./:-@\[-`{-~]*"
    phrase = F.when(F.size(tokens) > 1, F.concat(F.lit("(?i)"), F.array_join(F.transform(tokens, quoted), glue))).otherwise(
        F.lit(r"(?!)"))
    pieces, names = F.split(sentence, phrase, -1), F.regexp_extract_all(sentence, phrase, F.lit(0))

    def swapped(v: Column) -> Column:
        # a letter on the cut side keeps a cut from counting as a boundary
        def piece(p: Column, i: Column) -> Column:
            left = F.when(i > 0, "x").otherwise("")
            right = F.when(i < F.size(pieces) - 1, "x").otherwise("")
            out = F.regexp_replace(F.concat(left, p, right), bounded(v), mark)
            out = F.substring(out, F.length(left) + 1, F.length(out))
            out = F.substring(out, F.lit(1), F.length(out) - F.length(right))
            return F.concat(out, F.coalesce(F.get(names, i), F.lit("")))
        return F.when((v != "") & field.isNotNull(), F.array_join(F.transform(pieces, piece), ""))

    x = F.when(value.rlike(r"^\d+\.?\d*$"), value.try_cast("double"))
    integer = F.when(x == F.floor(x), X.number_format(x, 0))
    # a try costs many expressions a piece, so it is made once, not for the test and the result
    tries = [swapped(value), swapped(integer)]
    return F.coalesce(*[X.let(t, lambda out: F.when(out != sentence, out)) for t in tries], sentence)


# --- roles and conflicts -----------------------------------------------------------

# --- fixed values: strength of a match type ----------------------------------------
STRENGTH = {"hash_validated": 6, "field_name_direct": 4, "field_name_word_by_word": 3, "field_name_llm": 2,
            "field_value": 1, "": 0}
TRUSTED = ("hash_validated", "field_name_direct")


def _strength(match_type: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STRENGTH.items() for x in kv]), match_type), F.lit(0))


def assign_roles(detections: DataFrame, key: str) -> DataFrame:
    """Role per (key, pos, field): one primary a sentence, the others are foreign.

    Sentences choose in their order: a field that no earlier sentence chose, else any; the strongest detection, then
    the last name. The fold goes over the few sentences of one template, the chosen names are its state.
    """
    sentences = detections.groupBy(key, "pos").agg(F.collect_list(F.struct(_strength(F.col("match_type")).alias("strength"), "field")).alias("found"))
    templates = sentences.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "found"))).alias("sentences"))

    def choose(state: Column, s: Column) -> Column:
        best = X.let(F.filter(s["found"], lambda d: ~F.array_contains(state["used"], d["field"])),
                     lambda fresh: F.array_max(F.when(F.size(fresh) > 0, fresh).otherwise(s["found"]))["field"])
        return X.let(best, lambda f: F.struct(F.concat(state["used"], F.array(f)).alias("used"),
                                              F.concat(state["chosen"], F.array(F.struct(s["pos"].alias("pos"), f.alias("_primary")))).alias("chosen")))
    pos = detections.schema["pos"].dataType.simpleString()
    start = F.expr(f"struct(cast(array() as array<string>) as used, cast(array() as array<struct<pos:{pos},_primary:string>>) as chosen)")
    chosen = templates.select(key, F.inline(F.aggregate("sentences", start, choose, lambda x: x["chosen"])))
    return (detections.join(chosen, [key, "pos"])
            .withColumn("role", F.when(F.col("field") == F.col("_primary"), "primary").otherwise("foreign"))
            .drop("_primary"))


def _loser(a: Column, b: Column) -> Column:
    """Place of the detection that a conflict removes, NULL without one.

    They conflict when a's value is a word of b's name, or stands in b's value. A primary stays; against a name a foreign
    a goes; between values the more trusted, then the stronger, then the one with the longer name stays, a when they are level.
    """
    word = F.array_contains(F.split(F.trim(b["field"]), r"\s+"), a["value"])

    def weight(d: Column) -> Column:
        return F.struct(d["match_type"].isin(*TRUSTED).cast("int"), _strength(d["match_type"]), F.length(d["field"]))
    first = a["role"] == "primary"
    level = F.when(first, b["i"]).when(b["role"] == "primary", a["i"]).when(weight(a) >= weight(b), b["i"]).otherwise(a["i"])
    return F.when(word, F.when(first, b["i"]).otherwise(a["i"])).when(F.contains(b["value"], a["value"]), level)


def resolve_conflicts(detections: DataFrame, key: str) -> DataFrame:
    """Detections that survive the conflicts inside their sentence.

    Detections, in the order of their names, meet each other in turn; one that was removed meets nobody any more. A single
    detection, and sentences of validated tags only, have none. The fold goes over the handful of fields of one sentence.
    """
    packed = (detections.groupBy(key, "pos")
              .agg(F.array_sort(F.collect_list(F.struct("field", "value", "match_type", "role"))).alias("found")))
    numbered = F.transform("found", lambda d, i: d.withField("i", i))

    def meet(gone: Column, a: Column, b: Column) -> Column:
        loser = F.when((a["i"] != b["i"]) & ~F.array_contains(gone, a["i"]) & ~F.array_contains(gone, b["i"]), _loser(a, b))
        return X.let(loser, lambda i: F.when(i.isNull(), gone).otherwise(F.concat(gone, F.array(i))))

    def left(d: Column) -> Column:
        nobody = F.expr("cast(array() as array<int>)")
        gone = F.aggregate(d, nobody, lambda g, a: F.aggregate(d, g, lambda h, b: meet(h, a, b)))
        calm = (F.size(d) <= 1) | F.forall(d, lambda x: x["match_type"] == "hash_validated")
        return X.let(F.when(calm, nobody).otherwise(gone), lambda g: F.filter(d, lambda x: ~F.array_contains(g, x["i"])))
    kept = packed.select(key, "pos", F.explode(X.let(numbered, left)["field"]).alias("field"))
    return detections.join(kept, [key, "pos", "field"], "left_semi")


# --- tags --------------------------------------------------------------------------

def resolve_by_tag(sentences: DataFrame, tag_map: DataFrame) -> DataFrame:
    """Field of each tagged sentence: the known replacement text wins, else the cascade must find the value.

    ``sentences``: (row_id, tag, sentence); ``tag_map``: (row_id, tag, field, value, field_class, replacement).
    """
    j = sentences.join(by_shuffle(tag_map), ["row_id", "tag"])
    hit = field_in_sentence(F.col("sentence"), F.col("field"), F.col("value"), F.col("field_class"))
    j = j.withColumn("_hit", hit)
    shown = F.col("_hit.found") & has_value(F.col("sentence"), F.col("_hit.matched_text"))
    return j.select(
        "row_id", "tag", "field",
        F.when(F.col("replacement").isNotNull(), F.col("replacement")).when(shown, F.col("_hit.matched_text"))
        .otherwise(F.col("value")).alias("replacement_value"),
        F.when(F.col("replacement").isNotNull(), "hash_validated").when(shown, F.col("_hit.match_type"))
        .otherwise("needs_regeneration").alias("match_type"))


def _tag_place(narrative: Column, tag: Column) -> tuple[Column, Column, Column]:
    mark = F.concat(F.lit("(Hash: "), tag, F.lit(")"))
    at = F.call_function("locate", mark, narrative)
    left = F.substring(narrative, F.lit(1), at - 1)
    bar = F.call_function("locate", F.lit("|"), F.reverse(left))
    return mark, at, F.when(bar > 0, F.length(left) - bar + 1).otherwise(0)


def sentence_by_tag(narrative: Column, tag: Column) -> Column:
    """Text left of a tag to the nearest ``|`` (or ``.``), tag included; NULL when the tag is absent."""
    mark, at, bar = _tag_place(narrative, tag)
    left = F.substring(narrative, F.lit(1), at - 1)
    dot = F.call_function("locate", F.lit("."), F.reverse(left))
    start = F.when(bar > 0, bar + 1).when(dot > 0, F.length(left) - dot + 2).otherwise(1)
    return F.when(at > 0, F.trim(F.substring(narrative, start, at + F.length(mark) - start)))


def swap_sentence(narrative: Column, tag: Column, new: Column) -> Column:
    """Narrative with the delimited block of a tag replaced."""
    mark, at, bar = _tag_place(narrative, tag)
    after = F.call_function("locate", F.lit("|"), narrative, at + F.length(mark))
    end = F.when(after > 0, after).otherwise(F.length(narrative))
    out = F.concat(F.substring(narrative, F.lit(1), bar - 1), F.lit("| "), new, F.lit(" |"),
                   F.substring(narrative, end + 1, F.length(narrative)))
    return F.when((at > 0) & (bar > 0), out).otherwise(narrative)


# --- reports -----------------------------------------------------------------------

def confidence_of(match_type: Column) -> Column:
    return (F.when(match_type.isin("hash_validated", "field_name_direct", "tbd_skipped"), "high")
            .when(match_type.isin("field_name_word_by_word", "field_name_llm"), "medium")
            .when(match_type == "field_value", "low").otherwise("none"))


def analyze_templates(pairs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Detection result per (table, column).

    ``pairs``: (…, field, value, field_class, sentence); class COMPLEX counts as detected.
    """
    hit = field_in_sentence(F.col("sentence"), F.col("field"), F.col("value"), F.col("field_class"), names)
    tbd = F.col("field_class") == "COMPLEX"
    d = pairs.withColumn("_hit", hit)
    kind = F.when(tbd, "tbd_skipped").otherwise(F.col("_hit.match_type"))
    text = F.when(tbd, "TBD").otherwise(F.col("_hit.matched_text"))
    found = tbd | F.col("_hit.found")
    out = d.withColumns({"detected": found, "matched_text": text, "method": kind, "confidence": confidence_of(kind)})
    replaced = replace_match(F.col("sentence"), F.col("field"), F.col("matched_text"))
    return out.withColumn("replaced", F.col("detected") & ~tbd & replaced.isNotNull()).drop("_hit")


def table_rates(analysis: DataFrame, keys: list[str]) -> DataFrame:
    """Columns, detected columns and rate per table; 0 for no columns."""
    return analysis.groupBy(*keys).agg(
        F.count("*").alias("n_columns"), F.count_if("detected").alias("n_detected"),
        F.round(F.try_divide(F.count_if("detected") * 100.0, F.count("*")), 4).alias("rate"))


def detection_summary(analysis: DataFrame) -> DataFrame:
    """Totals overall and by database, class, method and confidence, in one pass of grouping sets."""
    dims = ["database", "field_class", "method", "confidence"]
    counted = analysis.groupingSets([[], *[[d] for d in dims]], *dims).agg(
        F.grouping_id().alias("_g"), F.count("*").alias("total"), F.count_if("detected").alias("detected"),
        F.count_if("replaced").alias("replaced"))
    # grouping id has a 0 bit for the column that is grouped
    which = {0b1111: ("all", F.lit("all")), **{0b1111 & ~(1 << (3 - i)): (d, F.col(d)) for i, d in enumerate(dims)}}
    name, value = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for gid, (label, col) in which.items():
        name, value = name.when(F.col("_g") == gid, label), value.when(F.col("_g") == gid, col)
    return counted.select(name.alias("dimension"), value.alias("value"), "total", "detected", "replaced")


def problem_tables(analysis: DataFrame, keys: list[str], threshold: float = 70.0) -> DataFrame:
    """Tables below the threshold with their undetected columns."""
    return (analysis.groupBy(*keys)
            .agg(F.round(F.count_if("detected") * 100.0 / F.count("*"), 4).alias("rate"),
                 F.array_sort(F.collect_set(F.when(~F.col("detected"), F.col("field")))).alias("undetected"))
            .where(F.col("rate") < threshold))


def remediate(rows: DataFrame, model: RowModel, rounds: int = 5) -> DataFrame:
    """Rewrite sentences whose field is not found, in bounded rounds over a shrinking set.

    ``rows``: (…, field, value, field_class, sentence). A rewrite counts when its value is
    found by the cascade and by a plain search; what is left at the end gets the
    stated sentence. Tags are kept. Adds ``fixed_in`` (0 = was fine, ``rounds + 1`` = stated).

    The first prompt is ``state, field, value``. Later ones are ``restate, field, value, round, reason, sentence``, with the sentence
    that was refused and why: ``no field``, ``no value`` or ``no answer`` (a null answer or a failing prompt, which leaves the
    sentence as it was). The open rows of each round are stored; the loop ends when none is left or a round has changed no sentence.
    """
    from textlake.session import cut_lineage
    base = rows.columns

    def judged(df: DataFrame) -> DataFrame:
        hit = field_in_sentence(F.col("sentence"), F.col("field"), F.col("value"), F.col("field_class"))
        plain = has_value(F.col("sentence"), F.col("value")) | ~F.col("field_class").isin("STANDARD")
        found, both = F.coalesce(hit["found"], F.lit(False)), F.coalesce(hit["found"] & plain, F.lit(False))
        why = F.when(~F.col("_said"), "no answer").when(~found, "no field").otherwise("no value")
        return df.withColumns({"_ok": both, "_why": why})

    state = cut_lineage(judged(rows.withColumn("_said", F.lit(True))))
    done = [state.where("_ok").select(*base, F.lit(0).alias("fixed_in"))]
    open_rows = state.where("not _ok")
    for n in range(1, rounds + 1):
        told = [F.coalesce(F.col(c), F.lit("")) for c in ("field", "value")]
        prompt = (F.concat_ws("\t", F.lit("state"), *told) if n == 1 else
                  F.concat_ws("\t", F.lit("restate"), *told, F.lit(str(n)), "_why", F.coalesce(strip_tag(F.col("sentence")), F.lit(""))))
        asked = open_rows.select(*base, prompt.alias("_prompt"))
        answered = model_map(asked, "_prompt", model, "_new", keep_errors=True)
        fresh = append_tag(F.col("_new"), F.coalesce(extract_tag(F.col("sentence")), F.lit("")))
        new = F.when(extract_tag(F.col("sentence")).isNotNull(), fresh).otherwise(F.col("_new"))
        said = answered.withColumns({"_said": F.col("_new").isNotNull(), "_old": F.col("sentence")})
        said = said.withColumn("sentence", F.when(F.col("_said"), new).otherwise(F.col("_old")))
        state = cut_lineage(judged(said).withColumn("_moved", ~F.col("sentence").eqNullSafe(F.col("_old"))).select(*base, "_ok", "_why", "_moved"))
        done.append(state.where("_ok").select(*base, F.lit(n).alias("fixed_in")))
        open_rows = state.where("not _ok")
        if open_rows.where("_moved").isEmpty():
            break
    stated = F.concat(F.lit("The "), "field", F.lit(" value is "), F.coalesce("value", F.lit("NULL")), F.lit("."))
    done.append(open_rows.select(*base).withColumn("sentence", stated).select(*base, F.lit(rounds + 1).alias("fixed_in")))
    return reduce(DataFrame.unionByName, done)


def extract_indicator(rows: DataFrame, model: RowModel, kind: str = "null_indicator",
                      cache: DataFrame | None = None) -> DataFrame:
    """Text of a sentence that expresses a missing, yes/no, date or list value, asked once per distinct sentence."""
    prompt = F.concat_ws("\t", F.lit(kind), F.col("sentence"))
    return model_map(rows.withColumn("_prompt", prompt), "_prompt", model, "indicator", cache).drop("_prompt")


