"""Rendering of table rows as documents.

Everything from a row to its document is one narrow projection: wordings are literals
of the plan, draws are functions of (seed, row, slot), so nothing is shuffled and a
rerun of a lost task gives the same text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlake import vocab
from textlake.functions import text as X
from textlake.operators.bank import Bank, Template, normalize_pattern, placeholder
from textlake.operators.ordering import number_rows
from textlake.sources.readers import value_text


# --- draws -------------------------------------------------------------------------

def draw(n: int | Column, *parts: Column) -> Column:
    """0-based draw below n from the md5 of the parts."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, n if isinstance(n, Column) else F.lit(n).cast("bigint")).cast("int")


def _choose(items: list[str], index: Column) -> Column:
    if len(items) == 1:
        return F.lit(items[0])
    return F.element_at(F.array(*[F.lit(i) for i in items]), index + 1)


# --- tags --------------------------------------------------------------------------

def make_tag(*parts: Column) -> Column:
    """16-hex tag that is the same on every run."""
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 16)


def append_tag(sentence: Column, tag: Column) -> Column:
    bare = F.rtrim(sentence)
    tagged = bare.endswith(")") & sentence.contains("(Hash:")
    return F.when(tagged, sentence).otherwise(F.concat(bare, F.lit(" (Hash: "), tag, F.lit(")")))


def extract_tag(sentence: Column) -> Column:
    return F.nullif(F.regexp_extract(sentence, vocab.TAG, 1), F.lit(""))


def extract_tags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(vocab.TAG), F.lit(1))


def strip_tag(sentence: Column) -> Column:
    return F.rtrim(F.regexp_replace(sentence, r"\s*\(Hash:\s*[a-f0-9]+\)", ""))


# --- one sentence ------------------------------------------------------------------

def sentence_for_value(field: Column, name: Column, value: Column, null_mode: str, binary_mode: str) -> Column:
    """Stated sentence of a value without a bank: missing, yes/no or plain."""
    missing = X.is_null_word(value, vocab.NULL_WORDS_SENTENCE)
    yes_no = F.trim(value).isin(vocab.BINARY_WORDS_SENTENCE)
    true = X.is_true_word(value)
    the = F.concat(F.lit("The "), name)
    null_text = F.lit(" is NULL." if null_mode == "explicit" else " is not specified.")
    if binary_mode == "explicit":
        binary_text = F.concat(the, F.lit(" is "), F.trim(value), F.lit("."))
    else:
        binary_text = F.concat(the, F.when(true, F.lit(" applies.")).otherwise(F.lit(" does not apply.")))
    return (F.when(missing, F.concat(the, null_text)).when(yes_no, binary_text)
            .otherwise(F.concat(the, F.lit(" is "), value, F.lit("."))))


def choose_pool(value: Column, klass: str, has_counter: bool, has_null: bool) -> Column:
    """Name of the pool that words a value."""
    missing, false = X.is_null_word(value), X.is_false_word(value)
    pool = F.when(F.lit(False), "std")
    if klass == "NULLABLE_BINARY":
        pool = pool.when(missing & F.lit(has_null), "null").when(false & F.lit(has_counter), "counter")
    elif klass == "NULL":
        pool = pool.when(missing & F.lit(has_counter), "counter")
    elif klass == "BINARY":
        pool = pool.when(false & F.lit(has_counter), "counter")
    return pool.otherwise("std")


def fill_placeholders(pattern: Column, values: dict[str, Column]) -> Column:
    """Put values into ``[FIELD]`` marks; unknown marks stay."""
    return reduce(lambda p, kv: F.replace(p, F.lit(placeholder(kv[0])), kv[1]), values.items(), pattern)


def fill_placeholders_map(pattern: Column, row: Column) -> Column:
    """As ``fill_placeholders`` for a row held as a map; marks match in any case."""
    quoted = F.regexp_replace
    return F.aggregate(F.map_entries(row), pattern, lambda p, e: F.regexp_replace(
        p, F.concat(F.lit(r"(?i)\[\Q"), e["key"], F.lit(r"\E\]")),
        quoted(e["value"], r"([\\$])", r"\\$1")))


def _is_text(dtype: T.DataType) -> bool:
    return not isinstance(dtype, T.NumericType)


def formatted(df: DataFrame, field: str, number: Column | None = None) -> Column:
    """Value text of a column inside a sentence; typed numbers skip text parsing."""
    dtype, c = df.schema[field].dataType, F.col(field)
    if isinstance(dtype, T.IntegralType) and not X.is_percent(field):
        return F.coalesce(c.cast("string"), F.lit("NULL"))
    if isinstance(dtype, T.NumericType):
        return X.number_text(field, c.cast("double"), F.lit("NULL"))
    text = F.coalesce(value_text(c, dtype), F.lit("NULL"))
    return X.format_value(field, text) if number is None else X.number_text(field, number, text)


def _worded(pool: tuple[str, ...], fields: list[str], label: str, key: Column, seed: str,
            ordinal: Column | None) -> Column:
    """A wording of the pool with the row's formatted values (columns ``_v_<field>``) put in."""
    if ordinal is None:
        index = draw(len(pool), F.lit(seed), key, F.lit(label))
    else:
        index = F.pmod(ordinal + draw(len(pool), F.lit(seed), F.lit(label)), F.lit(len(pool))).cast("int")
    patterns = [normalize_pattern(p) for p in pool]
    used = {f: F.col(f"_v_{f}") for f in fields if any(placeholder(f) in p for p in patterns)}
    return fill_placeholders(_choose(patterns, index), used)


def _slot_sentence(t: Template, fields: list[str], key: Column, seed: str, ordinal: Column | None) -> Column:
    label = t.field or "static"
    if t.field is not None and not t.std:
        return F.concat(F.lit(f"The {t.field} value is "), F.col(f"_v_{t.field}"), F.lit("."))
    sentence = _worded(t.std, fields, label, key, seed, ordinal)
    if t.field is None or t.klass == "STANDARD":
        return sentence
    chain = F.when(F.col(f"_pool_{t.field}") == "std", sentence)
    for name in ("counter", "null"):
        if t.pool(name):
            chain = chain.when(F.col(f"_pool_{t.field}") == name, _worded(t.pool(name), fields, label, key, seed, ordinal))
    return chain


def word_slots(df: DataFrame, bank: Bank, key: str, seed: str, ordinal: Column | None = None) -> DataFrame:
    """Add ``_s_<i>``, the filled wording of every slot.

    The steps are separate projections, so that a value, a pool and a sentence are each
    computed once however often later steps name them.
    """
    slots = [t for t in bank if t.field is None or t.field in df.columns]
    marks = " ".join(normalize_pattern(p) for t in slots for name in ("std", "counter", "null") for p in t.pool(name))
    fields = [f for f in df.columns if placeholder(f) in marks or any(t.field == f and not t.std for t in slots)
              or any(t.synonyms for t in slots)]
    texts = [f for f in fields if _is_text(df.schema[f].dataType)]
    raw = {t.field: F.coalesce(value_text(F.col(t.field), df.schema[t.field].dataType), F.lit("NULL"))
           for t in slots if t.field is not None and t.klass != "STANDARD"}
    out = df.withColumns({f"_n_{f}": X.to_number(value_text(F.col(f), df.schema[f].dataType)) for f in texts})
    out = out.withColumns({
        **{f"_v_{f}": formatted(df, f, F.col(f"_n_{f}") if f in texts else None) for f in fields},
        **{f"_pool_{t.field}": choose_pool(raw[t.field], t.klass, bool(t.counter), bool(t.null))
           for t in slots if t.field in raw}})
    k = F.col(key).cast("string")
    return out.withColumns({f"_s_{i}": _slot_sentence(t, fields, k, seed, ordinal) for i, t in enumerate(slots)})


# --- wording variation -------------------------------------------------------------

def _swap(sentence: Column, word: str, choices: list[str], index: Column) -> Column:
    """Replace a whole word by the chosen one, keeping upper, title and lower case."""
    def chosen(case) -> Column:
        return F.element_at(F.array(*[F.lit(case(c)) for c in choices]), index + 1)
    for case in (str.upper, str.capitalize, str.lower):
        sentence = F.regexp_replace(sentence, F.lit(rf"\b{case(word)}\b"), chosen(case))
    # mixed case takes the choice as it is written; index 0 is the word itself and changes nothing above
    return F.when(index == 0, sentence).otherwise(F.regexp_replace(sentence, F.lit(rf"(?i)\b{word}\b"), chosen(str)))


def _varier(word: str, choices: list[str], index: Column, held: Column):
    def vary(s: Column) -> Column:
        allowed = s.rlike(rf"(?i)\b{word}\b") & ~held.contains(word.lower())
        return F.when(allowed, _swap(s, word, choices, index)).otherwise(s)
    return vary


def lexical_vary(sentence: Column, synonyms: dict[str, tuple[str, ...]], values: list[Column], seed: str,
                 key: Column, ordinal: Column | None = None) -> Column:
    """Replace words by synonyms unless a data value of the row holds the word.

    With ``ordinal`` the choices count through all combinations, so none repeats
    before every one was used; otherwise each choice is a draw.
    """
    held = F.lower(F.concat_ws("\x01", *values))
    step = 1
    for word, options in synonyms.items():
        choices = [word, *[o for o in options if o != word]]
        n = len(choices)
        if n == 1:
            continue
        if ordinal is None:
            index = draw(n, F.lit(seed), key, F.lit(word))
        else:
            index = F.pmod(F.floor(ordinal / step), F.lit(n)).cast("int")
        step *= n

        sentence = X.let(sentence, _varier(word, choices, index, held))
    return sentence


# --- fixed values: neighbours that make a word part of a field name -----------------
NAME_TAILS = "Code|Name|Number|Type|Status|Count|Grade"
NAME_HEADS = "Academic|Charter|District|County|School|Free|FRPM|Enrollment|Percent"


def _consistent_varier(word: str, choices: list[str], index: Column, held: Column):
    phrase = rf"(?i)\b{word}\s+(?:{NAME_TAILS})\b|\b(?:{NAME_HEADS})\s+{word}\b"

    def vary(s: Column) -> Column:
        allowed = ~held.contains(word.lower()) & ~s.rlike(phrase)
        chosen = F.element_at(F.array(*[F.lit(c) for c in choices]), index + 1)
        return F.when(allowed, F.regexp_replace(s, F.lit(rf"\b{word}\b"), chosen)).otherwise(s)
    return vary


def lexical_vary_consistent(sentence: Column, synonyms: dict[str, tuple[str, ...]], values: list[Column],
                            seed: str, key: Column) -> Column:
    """One synonym per word for a whole document; also leaves field-name phrases alone."""
    held = F.lower(F.concat_ws("\x01", *values))
    for word, options in synonyms.items():
        choices = [word, *[o for o in options if o != word]]
        index = draw(len(choices), F.lit(seed), key, F.lit(word))
        sentence = X.let(sentence, _consistent_varier(word, choices, index, held))
    return sentence


# --- fixed values: words never offered for variation --------------------------------
STOP_WORDS = ["this", "that", "with", "from", "they", "have", "been", "were", "will", "would", "could", "should"]
FIELD_WORDS = ["code", "name", "number", "type", "status", "count", "id", "identifier", "date", "time", "year",
               "percent", "percentage", "total", "amount", "value"]


def keyword_candidates(sentence: Column, fields: list[str], values: list[Column], cap: int | None = None) -> Column:
    """Words worth varying: long enough, not a stop word, not part of a field name or value; all, or the first ``cap``."""
    words = F.regexp_extract_all(F.lower(sentence), F.lit(r"\b[a-z]{4,}\b"), F.lit(0))
    name_words = sorted({w for f in fields for w in "".join(
        ch if ch.isalpha() and ch.isascii() else " " for ch in f.lower()).split()})
    banned = F.array(*[F.lit(w) for w in STOP_WORDS + FIELD_WORDS + name_words])
    value_words = F.transform(F.split(F.lower(F.concat_ws(" ", *values)), r"\s+"),
                              lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", ""))
    kept = F.array_except(F.array_except(words, banned), value_words)
    return F.array_sort(kept) if cap is None else F.slice(F.array_sort(kept), 1, cap)


def build_synonym_sets(words: DataFrame, thesaurus: DataFrame, cap: int | None = None) -> DataFrame:
    """Synonyms per word: alphabetic, longer than two letters, the word itself first.

    With ``cap`` only the best ``cap - 1`` synonyms of a word survive the window, so no group grows; without, all are kept.
    """
    from pyspark.sql import Window
    fit = (thesaurus.where((F.length("synonym") > 2) & F.col("synonym").rlike(r"^\p{L}+$")
                           & (F.col("synonym") != F.col("word")))
           .groupBy("word", "synonym").agg(F.min("rank").alias("rank")))
    best = (words.select("word").distinct().join(fit, "word", "left")
            .withColumn("n", F.row_number().over(Window.partitionBy("word").orderBy("rank", "synonym")))
            .where(F.lit(True) if cap is None else F.col("n") < cap))
    listed = F.array_sort(F.collect_list(F.when(F.col("synonym").isNotNull(), F.struct("n", "synonym"))))
    return best.groupBy("word").agg(listed.alias("s")).select(
        "word", F.concat(F.array("word"), F.transform("s", lambda x: x["synonym"])).alias("synonyms"))


# --- noise -------------------------------------------------------------------------

def noise_count(n: Column, x: int | Column, y: int | Column) -> Column:
    """Noise sentences for n data sentences at ratio x:y."""
    x, y = (v if isinstance(v, Column) else F.lit(v) for v in (x, y))
    return F.when(y == 0, F.lit(0)).otherwise(F.greatest(y, F.ceil(n * y / x))).cast("int")


def weave_noise(sentences: Column, noise: list[str], x: int, y: int, seed: str, key: Column) -> Column:
    """Insert the right number of noise sentences, evenly spread after data sentences."""
    if y == 0:
        return sentences
    n = F.size(sentences)
    q = noise_count(n, x, y)
    bank = F.array(*[F.lit(s) for s in noise])

    def noise_at(j: Column) -> Column:
        return F.element_at(bank, draw(len(noise), F.lit(seed), key, F.lit("noise"), j.cast("string")) + 1)

    def first_slot(i: Column) -> Column:
        return F.floor((i * q + n - 1) / n).cast("int")

    def with_noise(s: Column, i: Column) -> Column:
        # noise sentence j follows data sentence floor(j * n / q)
        lo, hi = first_slot(i), first_slot(i + 1)
        mine = F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))
        return F.concat(F.array(s), F.transform(mine, noise_at))

    return F.flatten(F.transform(sentences, with_noise))


def narrative_text(sentences: Column) -> Column:
    """Pipe-delimited segments."""
    return F.array_join(F.transform(sentences, lambda s: F.concat(F.lit("| "), s, F.lit(" |"))), " ")


def raw_dump(sentences: Column) -> Column:
    """Pipe-delimited sentences as one paragraph each; unfinished (TBD) ones are left out."""
    kept = F.filter(sentences, lambda s: s != "TBD")
    return F.array_join(F.transform(kept, lambda s: F.concat(F.lit("| "), s, F.lit(" |"))), "\n\n")


def split_batches(sentences: Column, n: int) -> Column:
    """Near-equal batches of ``ceil(len / n)`` sentences."""
    size = F.size(sentences)
    step = F.ceil(size / F.greatest(F.least(F.lit(n), size), F.lit(1))).cast("int")
    starts = F.sequence(F.lit(1), size, step)
    return F.when(size > 0, F.transform(starts, lambda i: F.slice(sentences, i, step))).otherwise(
        F.array().cast("array<array<string>>"))


def batch_quota(total: Column, batches: Column) -> Column:
    """Noise sentences per batch; the remainder goes to the last."""
    base = F.floor(total / batches).cast("int")
    return F.transform(F.sequence(F.lit(1), batches), lambda i: F.when(
        i < batches, base).otherwise(total - base * (batches - 1)))


def format_paragraphs(narrative: Column) -> Column:
    flat = F.transform(F.split(narrative, "\n\n"), lambda p: F.replace(F.trim(p), F.lit("\n"), F.lit(" ")))
    return F.filter(flat, lambda p: p != "")


def word_count(s: Column) -> Column:
    return F.regexp_count(s, F.lit(r"\b[a-zA-Z]+\b"))


def merge_fragments(sentences: Column) -> Column:
    """Glue untagged fragments of one to three words to the sentence that follows."""
    def body(s: Column) -> Column:
        return F.trim(strip_tag(s))

    def glues(cur: Column, nxt: Column) -> Column:
        n = word_count(body(cur))
        return (extract_tag(cur).isNull() & n.between(1, 3) & (F.upper(body(cur)) != "TBD")
                & (F.upper(body(nxt)) != "TBD") & (word_count(body(nxt)) >= 2))

    def glue(cur: Column, nxt: Column) -> Column:
        low = F.concat(F.lower(F.substring(nxt, 1, 1)), F.substring(nxt, F.lit(2), F.length(nxt)))
        return F.concat(body(cur), F.lit(" "), F.when(body(cur).endswith(","), low).otherwise(nxt))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("cur"))

    def step(acc: Column, s: Column) -> Column:
        joined = F.coalesce(glues(acc["cur"], s), F.lit(False))
        out = F.when(acc["cur"].isNull() | joined, acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"])))
        return F.struct(out.alias("out"), F.when(joined, glue(acc["cur"], s)).otherwise(s).alias("cur"))

    return F.aggregate(sentences, start, step, lambda acc: F.when(acc["cur"].isNull(), acc["out"]).otherwise(
        F.concat(acc["out"], F.array(acc["cur"]))))


def bridge_fragments(sentences: Column, noise: list[str], seed: str, key: Column, min_words: int = 4) -> Column:
    """Replace untagged noise fragments by full noise sentences."""
    bank = F.array(*[F.lit(s) for s in noise])
    return F.transform(sentences, lambda s, i: F.when(
        extract_tag(s).isNull() & (word_count(s) < min_words),
        F.element_at(bank, draw(len(noise), F.lit(seed), key, F.lit("bridge"), i.cast("string")) + 1)).otherwise(s))


# --- documents ---------------------------------------------------------------------

def assemble_document(sentences: Column, seed: str, key: Column, transition_share: int = 3,
                      transition_case: str = "first") -> Column:
    """Paragraphs of two to four sentences, some opened by a transition.

    ``transition_share`` is in tenths. A transition lower-cases the first letter of the
    sentence, or the whole sentence with ``transition_case='all'``.
    """
    def piece(s: Column, i: Column, length: Column) -> Column:
        place = F.pmod(i, length)
        slot = i.cast("string")
        wanted = (place > 0) & (draw(10, F.lit(seed), key, F.lit("transition"), slot) < transition_share)
        bare = reduce(lambda a, b: a | b, [F.lower(s).startswith(w) for w in vocab.NO_TRANSITION_STARTS])
        words = F.element_at(F.array(*[F.lit(t) for t in vocab.TRANSITIONS]),
                             draw(len(vocab.TRANSITIONS), F.lit(seed), key, F.lit("word"), slot) + 1)
        low = (F.lower(s) if transition_case == "all"
               else F.concat(F.lower(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s))))
        text = F.when(wanted & ~bare, F.concat(words, F.lit(" "), low)).otherwise(s)
        gap = F.when(i == 0, "").when(place == 0, "\n\n").otherwise(" ")
        return F.concat(gap, text)

    return X.let(draw(3, F.lit(seed), key, F.lit("paragraph")) + 2, lambda length: F.array_join(
        F.transform(sentences, lambda s, i: piece(s, i, length)), ""))


def closing_sentence(column: str, value: Column, seed: str) -> Column:
    """Stated sentence of an embedded structure; the same value is always worded the same."""
    phrase = _choose(vocab.CLOSING_PHRASES, draw(len(vocab.CLOSING_PHRASES), F.lit(seed), F.lit(column), value))
    return X.clean_sentence(F.concat(phrase, F.lit(f" the {column} contains: "), value, F.lit(".")))


def render_sentences(df: DataFrame, bank: Bank, key: str, seed: str = "s0", no_repeat: bool = False,
                     clean: bool = True, carry: dict[str, Column] | None = None) -> DataFrame:
    """``(row_id, sentences)``: one sentence per bank slot, in bank order.

    ``no_repeat`` walks each pool in turn over the table's rows; the row numbers come
    from bucketed counts, never from one window over the table. ``carry`` adds columns.
    """
    source, ordinal = df, None
    if no_repeat:
        source, ordinal = number_rows(df, key, out="_ordinal"), F.col("_ordinal")
    slots = [t for t in bank if t.field is None or t.field in df.columns]
    worded = word_slots(source, bank, key, seed, ordinal)
    k = F.col(key).cast("string")
    held = [F.col(f"_v_{f}") for f in df.columns if f"_v_{f}" in worded.columns]
    varied = worded.withColumns({f"_s_{i}": lexical_vary(F.col(f"_s_{i}"), t.synonyms, held, seed, k, ordinal)
                                 for i, t in enumerate(slots) if t.synonyms})
    done = F.array(*[F.col(f"_s_{i}") for i in range(len(slots))])
    return varied.select(F.col(key).alias("row_id"),
                         (F.transform(done, X.clean_sentence) if clean else done).alias("sentences"),
                         *[c.alias(name) for name, c in (carry or {}).items()])


def render_documents(df: DataFrame, bank: Bank, key: str, table: str, seed: str = "s0",
                     noise: list[str] | None = None, ratio: tuple[int, int] = (1, 0),
                     complex_columns: tuple[str, ...] = (), no_repeat: bool = False,
                     transition_share: int = 3, limit: int | None = None) -> DataFrame:
    """Documents ``(row_id, filename, sentences, contents)`` of a table's rows.

    ``complex_columns`` are worded in a closing paragraph. ``limit`` renders the first
    rows by key only, for trial corpora.
    """
    if limit is not None:
        df = df.orderBy(key).limit(limit)
    k = F.col("row_id").cast("string")
    closing = [closing_sentence(c, F.col(c), seed) for c in complex_columns]
    docs = render_sentences(df, bank, key, seed, no_repeat,
                            carry={"_closing": F.concat_ws(" ", *closing)} if closing else None)
    docs = docs.withColumn("sentences", weave_noise(F.col("sentences"), noise or [], *ratio, seed, k))
    body = assemble_document(F.col("sentences"), seed, k, transition_share)
    if closing:
        body = F.concat(body, F.lit("\n\n"), F.col("_closing"))
    return docs.select("row_id", F.concat(F.lit(table), k, F.lit(".txt")).alias("filename"), "sentences",
                       body.alias("contents"))


def render_consistent(df: DataFrame, bank: Bank, key: str, seed: str = "s0", min_length: int = 15) -> DataFrame:
    """Documents with one synonym per word throughout; short sentences are dropped."""
    slots = [t for t in bank if t.field is None or t.field in df.columns]
    worded = word_slots(df, bank, key, seed)
    k = F.col(key).cast("string")
    held = [F.col(f"_v_{f}") for f in df.columns if f"_v_{f}" in worded.columns]
    varied = worded.withColumns({f"_s_{i}": lexical_vary_consistent(F.col(f"_s_{i}"), t.synonyms, held, seed, k)
                                 for i, t in enumerate(slots) if t.synonyms})
    done = F.array(*[F.col(f"_s_{i}") for i in range(len(slots))])
    kept = F.filter(F.transform(done, X.clean_sentence), lambda s: F.length(s) > min_length)
    return (varied.select(F.col(key).alias("row_id"), kept.alias("sentences"))
            .withColumn("contents", F.array_join("sentences", " ")))
