"""Queries over corpus generation (GEN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake import vocab
from textlake.functions import text as X
from textlake.operators import render as R
from textlake.operators.bank import variation_class
from textlake.operators.generate import expand_variations, templates_from_sentences
from textlake.operators.detect import assign_roles, resolve_conflicts, templatize
from textlake.operators.model import FRAMES, RuleModel
from textlake.plans import ducksql as D
from textlake.plans import rendersql as RS
from textlake.plans.banks import NOISE, ORDER_BANK, customer_bank
from textlake.plans.base import query, table
from textlake.plans.corpora import ORDERS_DATED, customer_docs, order_docs, orders_dated
from textlake.plans.fixtures import CUSTOMER_X, LONG_CTE, customer_x, duck, profile_rows
from textlake.plans.txt import _PROTECT, _STRIP
from textlake.operators.profile import unpivot_rows
from textlake.session import scratch_path

# sentences of the given documents, for operators over arrays of any length
SENTENCES_SQL = rf"""select doc_id, list_filter(list_transform(regexp_split_to_array({_PROTECT}, '\.|[!?]+'),
 lambda s: replace({_STRIP}, chr(1), '.')), lambda s: length(s) > 10) as s from documents"""


def document_sentences(spark, sf):
    return table(spark, sf, "documents", heavy=True).select("doc_id", X.split_sentences(F.col("text")).alias("s"))


@query("gen_1_tags", """select p_partkey, tag, tagged, tag as found, p_name || '.' as plain, 2::integer as n_tags from
 (select *, p_name || '. (Hash: ' || tag || ')' as tagged from (select *, substr(md5(concat_ws('|', 'db', 'part', 'p_name', p_name || '.')), 1, 16) as tag from part))""")
def _(spark, sf):
    s = F.concat("p_name", F.lit("."))
    tag = R.make_tag(F.lit("db"), F.lit("part"), F.lit("p_name"), s)
    t = table(spark, sf, "part").select("p_partkey", tag.alias("tag"), R.append_tag(s, tag).alias("tagged"))
    again = R.append_tag(F.col("tagged"), F.lit("0a1b"))
    return t.select("p_partkey", "tag", again.alias("tagged"), R.extract_tag(F.col("tagged")).alias("found"),
                    R.strip_tag(F.col("tagged")).alias("plain"),
                    F.size(R.extract_tags(F.concat("tagged", F.lit(" | x (Hash: 0a) |")))).alias("n_tags"))


def _value_sentence(nm: str, bm: str) -> str:
    null_text = "is NULL." if nm == "explicit" else "is not specified."
    yes = ("'The ' || field || ' is ' || trim(value) || '.'" if bm == "explicit" else
           f"'The ' || field || case when upper(trim(value)) in ({D.words(vocab.TRUE_WORDS)}) then ' applies.' else ' does not apply.' end")
    return f"""case when upper(trim(coalesce(value, 'NULL'))) in ({D.words(vocab.NULL_WORDS_SENTENCE)}) then 'The ' || field || ' {null_text}'
 when trim(value) in ({D.words(vocab.BINARY_WORDS_SENTENCE)}) then {yes} else 'The ' || field || ' is ' || value || '.' end"""


@query("gen_2_sentence_for_value", f"""{LONG_CTE} select row_id, field, {_value_sentence('explicit', 'explicit')} as explicit_text,
 {_value_sentence('implicit', 'implicit')} as implicit_text from l""")
def _(spark, sf):
    f, v = F.col("field"), F.col("value")
    return unpivot_rows(profile_rows(spark, sf), "row_id").select(
        "row_id", "field", R.sentence_for_value(f, f, v, "explicit", "explicit").alias("explicit_text"),
        R.sentence_for_value(f, f, v, "implicit", "implicit").alias("implicit_text"))


@query("gen_3_variation_class", """select l_orderkey, case when bool_or(pool = 'std') and bool_or(pool = 'counter') and bool_or(pool = 'null') then 'NULLABLE_BINARY'
 when bool_or(pool = 'std') and bool_or(pool = 'counter') and bool_or(pool = 'counter' and contains(lower(pattern), 'null')) then 'NULL'
 when bool_or(pool = 'std') and bool_or(pool = 'counter') then 'BINARY' else 'STANDARD' end as variation_class from (select l_orderkey,
 case l_suppkey % 5 when 0 then 'counter' when 1 then 'null' else 'std' end as pool, case l_partkey % 4 when 0 then 'It is NULL.' else 'It is [X].' end as pattern
 from lineitem) group by l_orderkey""")
def _(spark, sf):
    bank = table(spark, sf, "lineitem", heavy=True).select(
        "l_orderkey", F.expr("case l_suppkey % 5 when 0 then 'counter' when 1 then 'null' else 'std' end").alias("pool"),
        F.expr("case l_partkey % 4 when 0 then 'It is NULL.' else 'It is [X].' end").alias("pattern"))
    return variation_class(bank, ["l_orderkey"])


_BANK = {t.field: t for t in customer_bank()}


@query("gen_4_choose_pool", f"""select c_custkey, {RS.pool_of('cast(opted_in as varchar)', _BANK['opted_in'])} as opted_in,
 {RS.pool_of('channel', _BANK['channel'])} as channel, {RS.pool_of('cast(is_debtor as varchar)', _BANK['is_debtor'])} as is_debtor,
 {RS.pool_of('c_name', _BANK['c_name'])} as c_name from ({duck(CUSTOMER_X)})""")
def _(spark, sf):
    return customer_x(spark, sf).select("c_custkey", *[
        R.choose_pool(F.coalesce(F.col(f).cast("string"), F.lit("NULL")), _BANK[f].klass, bool(_BANK[f].counter),
                      bool(_BANK[f].null)).alias(f) for f in ("opted_in", "channel", "is_debtor", "c_name")])


@query("gen_5_pick_variation", f"""select o_orderkey, cast({RS.draw(15, "'s0'", "cast(o_orderkey as varchar)", "'o_totalprice'")} as integer) as pick from orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", R.draw(
        15, F.lit("s0"), F.col("o_orderkey").cast("string"), F.lit("o_totalprice")).alias("pick"))


@query("gen_5_pick_no_repeat", f"""with {RS.sentences_cte(
    "select *, row_number() over (order by o_orderkey) as _o from (" + ORDERS_DATED + ")", ORDER_BANK, RS.ORDER_KINDS, 'o_orderkey', ordinal='_o')}
 select row_id, array_to_string(sentences, '#') as sentences from sents""")
def _(spark, sf):
    s = R.render_sentences(orders_dated(spark, sf), ORDER_BANK, "o_orderkey", no_repeat=True)
    return s.withColumn("sentences", F.array_join("sentences", "#"))


@query("gen_6_fill_placeholders", """select p_partkey, 'The ' || p_name || ' by ' || p_brand || ' has [COLOR] and ' || cast(p_size as varchar) || ' of $1\\' as filled from part""")
def _(spark, sf):
    row = F.create_map(F.lit("p_name"), "p_name", F.lit("p_brand"), "p_brand", F.lit("p_size"),
                       F.concat(F.col("p_size").cast("string"), F.lit(" of $1\\")))
    pattern = F.lit("The [P_Name] by [P_BRAND] has [COLOR] and [p_size]")
    return table(spark, sf, "part").select("p_partkey", R.fill_placeholders_map(pattern, row).alias("filled"))


_SYN = {"item": ("article", "piece"), "stock": ("store",), "ring": ("band",), "kept": ("held",)}
_TPL = R.Template(None, ("x",), synonyms=_SYN)
_VARY_SRC = "select p_partkey, p_name, p_brand, 'The item ' || p_brand || ' is KEPT in Stock as a ring item.' as w from part"


@query("gen_7_lexical_vary", f"""select p_partkey, {RS.lexical('w', _TPL, {'p_name': 'string', 'p_brand': 'string'}, 'cast(p_partkey as varchar)', 's0')} as varied
 from ({_VARY_SRC})""")
def _(spark, sf):
    w = F.concat(F.lit("The item "), "p_brand", F.lit(" is KEPT in Stock as a ring item."))
    return table(spark, sf, "part").select("p_partkey", R.lexical_vary(
        w, _SYN, [F.col("p_name"), F.col("p_brand")], "s0", F.col("p_partkey").cast("string")).alias("varied"))


def _consistent_sql(s: str, synonyms: dict, held: str, key: str) -> str:
    for word, options in synonyms.items():
        choices = [word, *[o for o in options if o != word]]
        idx = RS.draw(len(choices), "'s0'", key, D.q(word))
        phrase = rf"(?i)\b{word}\s+(?:{R.NAME_TAILS})\b|\b(?:{R.NAME_HEADS})\s+{word}\b"
        whens = " ".join(f"when {i} then regexp_replace({s}, '\\b{word}\\b', '{c}', 'g')" for i, c in enumerate(choices) if i)
        s = f"(case when contains({held}, '{word}') or regexp_matches({s}, '{phrase}') then {s} else case {idx} {whens} else {s} end end)"
    return s


@query("gen_8_lexical_vary_consistent", f"""select p_partkey, {_consistent_sql('w', _SYN, "lower(concat_ws(chr(1), p_name, p_brand))", 'cast(p_partkey as varchar)')} as varied
 from (select p_partkey, p_name, p_brand, case when p_partkey % 2 = 0 then 'The item name is ' else 'The item is ' end || p_brand || ', kept in stock with free ring.' as w from part)""")
def _(spark, sf):
    w = F.expr("case when p_partkey % 2 = 0 then 'The item name is ' else 'The item is ' end || p_brand || ', kept in stock with free ring.'")
    return table(spark, sf, "part").select("p_partkey", R.lexical_vary_consistent(
        w, _SYN, [F.col("p_name"), F.col("p_brand")], "s0", F.col("p_partkey").cast("string")).alias("varied"))


_BANNED = R.STOP_WORDS + R.FIELD_WORDS + ["p", "brand", "name"]


@query("gen_9_keyword_candidates", rf"""select p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(w), '\b[a-z]{{4,}}\b'),
 lambda k: not list_contains([{D.words(_BANNED)}], k) and not list_contains(list_transform(string_split(lower(p_name || ' ' || p_brand), ' '),
 lambda v: regexp_replace(v, '[^\p{{L}}\p{{N}}_]', '', 'g')), k))))[1:8], ' ') as words
 from (select *, 'This ' || p_name || ' with brand ' || p_brand || ' comes from stable supplies and would count toward early spring selling targets beyond plans.' as w from part)""")
def _(spark, sf):
    w = F.concat(F.lit("This "), "p_name", F.lit(" with brand "), "p_brand", F.lit(
        " comes from stable supplies and would count toward early spring selling targets beyond plans."))
    return table(spark, sf, "part").select("p_partkey", F.array_join(R.keyword_candidates(
        w, ["p_name", "p_brand"], [F.col("p_name"), F.col("p_brand")], cap=8), " ").alias("words"))


@query("gen_9_all_keywords", rf"""select p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(w), '\b[a-z]{{4,}}\b'),
 lambda k: not list_contains([{D.words(_BANNED)}], k)))), ' ') as words from (select *, 'Many ' || p_name || ' articles under label ' || p_brand ||
 ' leave several warehouses before noon, cross seven bridges, reach distant harbours and return without damage.' as w from part)""")
def _(spark, sf):
    w = F.concat(F.lit("Many "), "p_name", F.lit(" articles under label "), "p_brand", F.lit(
        " leave several warehouses before noon, cross seven bridges, reach distant harbours and return without damage."))
    return table(spark, sf, "part").select("p_partkey", F.array_join(R.keyword_candidates(w, ["p_name", "p_brand"], []), " ").alias("words"))


@query("gen_10_assemble_document", f"""select doc_id, md5({RS.assemble('s', 'cast(doc_id as varchar)')}) as body from ({SENTENCES_SQL})""")
def _(spark, sf):
    return document_sentences(spark, sf).select("doc_id", F.md5(R.assemble_document(
        F.col("s"), "s0", F.col("doc_id").cast("string"))).alias("body"))


@query("gen_11_closing_sentences", f"""select event_id, {D.clean_sentence(
    RS.listed(vocab.CLOSING_PHRASES) + "[1 + " + RS.draw(7, "'s0'", "'props'", "props") + "] || ' the props contains: ' || props || '.'")} as closing from events""")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", R.closing_sentence("props", F.col("props"), "s0").alias("closing"))


def _render_query(nm: str, bm: str, ratio: tuple[int, int]) -> None:
    key = f"gen_12_render_{nm}_null_{bm}_binary_{ratio[0]}_{ratio[1]}"
    sql = f"""with {RS.documents_sql(duck(CUSTOMER_X), customer_bank(nm, bm), RS.CUSTOMER_KINDS, 'c_custkey', 'customer', noise=NOISE, ratio=ratio)}
 select row_id, filename, contents from docs"""

    def run(spark, sf):
        return customer_docs(spark, sf, nm, bm, ratio).select("row_id", "filename", "contents")
    query(key, sql)(run)


for _nm, _bm, _ratio in [("implicit", "implicit", (1, 0)), ("explicit", "explicit", (1, 1)),
                         ("explicit", "implicit", (1, 2)), ("implicit", "explicit", (2, 1))]:
    _render_query(_nm, _bm, _ratio)


@query("gen_12_render_orders", f"""with {RS.documents_sql(ORDERS_DATED, ORDER_BANK, RS.ORDER_KINDS, 'o_orderkey', 'orders')}
 select row_id, filename, contents from docs""")
def _(spark, sf):
    return order_docs(spark, sf).select("row_id", "filename", "contents")


def _consistent_docs_sql() -> str:
    bank = customer_bank()
    k = "cast(c_custkey as varchar)"
    raw = ", ".join(f"{RS.slot(t, RS.CUSTOMER_KINDS, k, 's0')} as w{i}" for i, t in enumerate(bank))
    held = "lower(concat_ws(chr(1), " + ", ".join(RS.formatted(f, kd) for f, kd in RS.CUSTOMER_KINDS.items()) + "))"
    lex = ", ".join(f"{_consistent_sql(f'w{i}', t.synonyms, held, k)} as x{i}" for i, t in enumerate(bank))
    clean = ", ".join(D.clean_sentence(f"x{i}") for i in range(len(bank)))
    return f"""with src as ({duck(CUSTOMER_X)}), raw as (select *, {raw} from src), lex as (select *, {lex} from raw)
 select c_custkey as row_id, array_to_string(list_filter([{clean}], lambda s: length(s) > 30), ' ') as contents from lex"""


@query("gen_13_render_consistent", _consistent_docs_sql())
def _(spark, sf):
    return R.render_consistent(customer_x(spark, sf), customer_bank(), "c_custkey", min_length=30).select("row_id", "contents")


@query("gen_14_noise_count", """select l_orderkey, case when y = 0 then 0 else greatest(y, cast(ceil(n * y / cast(x as double)) as integer)) end as noise from (select l_orderkey, count(*) as n,
 cast(1 + l_orderkey % 3 as integer) as x, cast(l_orderkey % 4 as integer) as y from lineitem group by l_orderkey)""")
def _(spark, sf):
    n = table(spark, sf, "lineitem", heavy=True).groupBy("l_orderkey").agg(F.count("*").alias("n"))
    k = F.col("l_orderkey")
    return n.select("l_orderkey", R.noise_count(F.col("n"), (1 + k % 3).cast("int"), (k % 4).cast("int")).alias("noise"))


@query("gen_15_weave_noise", f"""select doc_id, len(w) - len(s) as added, md5(array_to_string(w, '|')) as woven, md5(array_to_string(list_transform(s, lambda x: '| ' || x || ' |'), chr(10) || chr(10))) as dump
 from (select doc_id, s, {RS.weave('s', NOISE, 2, 1, 'cast(doc_id as varchar)')} as w from ({SENTENCES_SQL}))""")
def _(spark, sf):
    d = document_sentences(spark, sf).withColumn("w", R.weave_noise(
        F.col("s"), NOISE, 2, 1, "s0", F.col("doc_id").cast("string")))
    return d.select("doc_id", (F.size("w") - F.size("s")).cast("bigint").alias("added"),
                    F.md5(F.array_join("w", "|")).alias("woven"), F.md5(R.raw_dump(F.col("s"))).alias("dump"))


@query("gen_16_split_batches", f"""select doc_id, len(b) as n_batches, array_to_string(list_transform(b, lambda x: cast(len(x) as varchar)), ' ') as sizes,
 array_to_string(list_transform(range(1, len(b) + 1), lambda i: cast(case when i < len(b) then 7 // len(b) else 7 - (7 // len(b)) * (len(b) - 1) end as varchar)), ' ') as quota
 from (select doc_id, list_transform(range(0, len(s), k), lambda i: s[i + 1:i + k]) as b from (select doc_id, s, cast(ceil(len(s) / cast(least(9, len(s)) as double)) as int) as k from ({SENTENCES_SQL}) where len(s) > 0))""")
def _(spark, sf):
    d = document_sentences(spark, sf).where(F.size("s") > 0).select("doc_id", R.split_batches(F.col("s"), 9).alias("b"))
    sizes = F.transform("b", lambda x: F.size(x).cast("string"))
    quota = F.transform(R.batch_quota(F.lit(7), F.size("b")), lambda x: x.cast("string"))
    return d.select("doc_id", F.size("b").cast("bigint").alias("n_batches"), F.array_join(sizes, " ").alias("sizes"),
                    F.array_join(quota, " ").alias("quota"))


@query("gen_17_format_paragraphs", """select doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: replace(trim(p), chr(10), ' ')),
 lambda p: p <> ''), '#')) as paragraphs from documents""")
def _(spark, sf):
    return table(spark, sf, "documents", heavy=True).select("doc_id", F.md5(F.array_join(
        R.format_paragraphs(F.col("text")), "#")).alias("paragraphs"))


_FRAME_VALUES = ", ".join(f"({i}, {D.q(b)})" for i, (b, _) in enumerate(FRAMES))


@query("gen_18_expand_variations", f"""select p_partkey, cast(vid as integer) as vid, case when before = '' then s else before || lower(s[1:1]) || s[2:] end as wording
 from (select p_partkey, 'The part is a ' || p_name || '.' as s from part), (values {_FRAME_VALUES}) f(vid, before)""")
def _(spark, sf):
    s = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("The part is a "), "p_name", F.lit(".")).alias("sentence"))
    return expand_variations(s, 15, RuleModel(), cache_path=scratch_path(spark, "wordings")).select("p_partkey", "vid", "wording")


@query("gen_19_build_synonym_sets", r"""with t as (select distinct split_part(p_name, ' ', 1) as word, split_part(p_name, ' ', 2) as synonym, min(p_size) as rank from part group by 1, 2),
 f as (select word, synonym, row_number() over (partition by word order by rank, synonym) as n from t where length(synonym) > 2 and synonym <> word)
 select word, word || ' ' || string_agg(synonym, ' ' order by n) as synonyms from f where n < 6 group by word""")
def _(spark, sf):
    names = F.split("p_name", " ")
    thesaurus = table(spark, sf, "part").select(names[0].alias("word"), names[1].alias("synonym"), F.col("p_size").alias("rank"))
    sets = R.build_synonym_sets(thesaurus.select("word"), thesaurus, cap=6)
    return sets.select("word", F.array_join("synonyms", " ").alias("synonyms"))


@query("gen_19_all_synonyms", r"""with t as (select distinct split_part(p_name, ' ', 1) as word, split_part(p_name, ' ', -1) || p_size as synonym, min(p_retailprice) as rank from part group by 1, 2),
 f as (select word, regexp_replace(synonym, '[0-9]+', repeat('x', cast(regexp_extract(synonym, '[0-9]+') as integer))) as synonym, rank from t)
 select word, word || ' ' || string_agg(synonym, ' ' order by rank, synonym) as synonyms from f group by word""")
def _(spark, sf):
    names = F.split("p_name", " ")
    thesaurus = table(spark, sf, "part").select(names[0].alias("word"), F.concat(F.element_at(names, -1), F.expr("repeat('x', cast(p_size as int))")).alias("synonym"),
                                                F.col("p_retailprice").alias("rank"))
    return R.build_synonym_sets(thesaurus.select("word"), thesaurus).select("word", F.array_join("synonyms", " ").alias("synonyms"))


_FRAG_SQL = """select o_orderkey, [case o_orderkey % 3 when 0 then 'In fact,' when 1 then 'Note well' else 'A plain opening sentence.' end,
 'The price is ' || cast(o_custkey as varchar) || '. (Hash: 0a1b)', case when o_orderkey % 4 = 0 then 'TBD' else 'So' end,
 case when o_orderkey % 5 = 0 then 'TBD' else 'Also' end, 'Dated items follow here.', 'End'] as s from orders"""
_MERGE = r"""len(regexp_extract_all(regexp_replace(c, '\s*\(Hash:\s*[a-f0-9]+\)', '', 'g'), '\b[a-zA-Z]+\b')) between 1 and 3 and not contains(c, '(Hash:') and c <> 'TBD' and x <> 'TBD'
 and len(regexp_extract_all(regexp_replace(x, '\s*\(Hash:\s*[a-f0-9]+\)', '', 'g'), '\b[a-zA-Z]+\b')) >= 2"""


@query("gen_23_merge_fragments", f"""with recursive d as ({_FRAG_SQL}), r as (select o_orderkey, s, 1 as i, ''::varchar as out, s[1] as c from d union all
 select o_orderkey, s, i + 1, case when m then out else out || c || chr(10) end, case when m then c || ' ' || case when c like '%,' then lower(x[1:1]) || x[2:] else x end else x end
 from (select *, ({_MERGE}) as m from (select *, s[i + 1] as x from r where i < len(s))))
 select o_orderkey, out || c as merged from r where i = len(s)""")
def _(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", F.expr(
        """array(case o_orderkey % 3 when 0 then 'In fact,' when 1 then 'Note well' else 'A plain opening sentence.' end,
        'The price is ' || cast(o_custkey as string) || '. (Hash: 0a1b)', case when o_orderkey % 4 = 0 then 'TBD' else 'So' end,
        case when o_orderkey % 5 = 0 then 'TBD' else 'Also' end, 'Dated items follow here.', 'End')""").alias("s"))
    return d.select("o_orderkey", F.array_join(R.merge_fragments(F.col("s")), "\n").alias("merged"))


@query("gen_25_bridge_fragments", f"""select o_orderkey, array_to_string(list_transform(range(len(s)), lambda i: case when not contains(s[i + 1], '(Hash:')
 and len(regexp_extract_all(s[i + 1], '\\b[a-zA-Z]+\\b')) < 4 then {RS.listed(NOISE)}[1 + {RS.draw(5, "'s0'", "cast(o_orderkey as varchar)", "'bridge'", "cast(i as varchar)")}] else s[i + 1] end), chr(10)) as bridged
 from ({_FRAG_SQL})""")
def _(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", F.expr(
        """array(case o_orderkey % 3 when 0 then 'In fact,' when 1 then 'Note well' else 'A plain opening sentence.' end,
        'The price is ' || cast(o_custkey as string) || '. (Hash: 0a1b)', case when o_orderkey % 4 = 0 then 'TBD' else 'So' end,
        case when o_orderkey % 5 = 0 then 'TBD' else 'Also' end, 'Dated items follow here.', 'End')""").alias("s"))
    return d.select("o_orderkey", F.array_join(R.bridge_fragments(
        F.col("s"), NOISE, "s0", F.col("o_orderkey").cast("string")), "\n").alias("bridged"))
