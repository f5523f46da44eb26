"""Queries over detection (DET) and the bank-building rules that use it (GEN 20-24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake import vocab
from textlake.operators import detect as DT
from textlake.operators import render as R
from textlake.operators.generate import templates_from_sentences
from textlake.operators.model import RuleModel
from textlake.plans import ducksql as D
from textlake.plans.base import query, table

# the edge class as RE2 writes it
EDGE = r"[\s!-,./:-@\[-`{-~]"


def esc(v: str) -> str:
    return rf"regexp_replace({v}, '([^A-Za-z0-9_\s])', '\\\1', 'g')"


def bounded(s: str, v: str) -> str:
    return f"regexp_matches({s}, '(?i)(?:^|{EDGE})' || {esc(v)} || '(?:$|{EDGE})')".replace("`", "`")


# pairs of a sentence and a field: five wordings per part, some of which lose name or value
_PAIRS = """select p_partkey as row_id, pos, case pos when 0 then 'brand name' when 1 then 'size' when 2 then 'retail price' when 3 then 'category (main)' else 'ring count' end as field,
 case pos when 0 then p_brand when 1 then cast(p_size as {string}) when 2 then {price} when 3 then p_type else cast(p_partkey as {string}) end as value,
 case pos when 0 then case p_partkey % 3 when 0 then 'The brand name is ' || p_brand || '.' when 1 then 'Its name and its brand are known.' else p_brand || ' made it.' end
 when 1 then case p_partkey % 3 when 0 then 'Sizes reach ' || cast(p_size as {string}) || ', as said.' when 1 then 'It reaches ' || cast(p_size as {string}) || ' units.' else 'Nothing is said.' end
 when 2 then case p_partkey % 2 when 0 then 'The retail price is ' || {price} || '.' else 'Shops ask ' || {price} || ' for it' end
 when 3 then case p_partkey % 2 when 0 then 'Category main is ' || lower(p_type) || '.' else 'The main thing is its category.' end
 else 'The count of one ring is ' || cast(p_partkey as {string}) || '.' end as sentence
 from {part} {cross}"""
_PAIRS_DUCK = (_PAIRS.replace("{string}", "varchar").replace("{price}", "printf('%.2f', p_retailprice)")
               .replace("{part}", "part").replace("{cross}", ", (values (0), (1), (2), (3), (4)) v(pos)"))


def pairs(spark, sf):
    sql = (_PAIRS.replace("{string}", "string").replace("{price}", "format_number(p_retailprice, '0.00')")
           .replace("{cross}", "lateral view explode(array(0, 1, 2, 3, 4)) v as pos"))
    return spark.sql(sql, part=table(spark, sf, "part", heavy=True))


_NAME_KIND = f"""case when field = 'brand name' then case when regexp_matches(sentence, '(?i)\\bbrand names?\\b') then 'field_name_direct'
 when regexp_matches(sentence, '(?i)\\bbrand\\b') and regexp_matches(sentence, '(?i)\\bname\\b') then 'field_name_word_by_word' when {bounded('sentence', 'value')} then 'field_value' else '' end
 when field = 'size' then case when regexp_matches(sentence, '(?i)\\bsizes?\\b') then 'field_name_direct' when {bounded('sentence', 'value')} then 'field_value' else '' end
 when field = 'retail price' then case when regexp_matches(sentence, '(?i)\\bretail prices?\\b') then 'field_name_direct' when {bounded('sentence', 'value')} then 'field_value' else '' end
 when field = 'category (main)' then case when regexp_matches(sentence, '(?i)category main') then 'field_name_direct'
 when regexp_matches(sentence, '(?i)\\bcategory\\b') and regexp_matches(sentence, '(?i)\\bmain\\b') then 'field_name_word_by_word' else '' end
 else 'field_name_word_by_word' end"""


@query("det_1_name_in_sentence", f"select row_id, pos, {_NAME_KIND} as match_type from ({_PAIRS_DUCK})")
def _(spark, sf):
    return pairs(spark, sf).select("row_id", "pos", DT.name_in_sentence(
        F.col("sentence"), F.col("field"), F.col("value")).alias("match_type"))


_ORD = """case when v % 100 between 10 and 20 then 'th' when v % 10 = 1 then 'st' when v % 10 = 2 then 'nd' when v % 10 = 3 then 'rd' else 'th' end"""


@query("det_2_value_variants_int", f"""select o_orderkey, array_to_string(list_filter([cast(v as varchar), cast(v as varchar) || {_ORD},
 case when v >= 1000 then format('{{:,}}', v) end], lambda x: x is not null), '|') as variants from (select o_orderkey, o_custkey as v from orders)""")
def _(spark, sf):
    v = F.col("o_custkey").cast("string")
    return table(spark, sf, "orders", heavy=True).select("o_orderkey", F.array_join(DT.value_variants(v), "|").alias("variants"))


_DEC = ", ".join(f"printf('%.{d}f', x), regexp_replace(printf('%.{d}f', x), '(\\.\\d+?)0+$', '\\1')" for d in range(1, 11))
_PCT = ", ".join(f"case when x <> 0 and abs(x) < 1 then printf('%.{d}f', x * 100) || '%' end, case when x <> 0 and abs(x) < 1 then printf('%.{d}f', x * 100) end" for d in range(5))


def _first_seen(items: str) -> str:
    """Distinct list in first-seen order."""
    return f"list_filter({items}, lambda e, i: list_position({items}, e) = i)"


@query("det_2_value_variants_decimal", f"""select o_orderkey, array_to_string({_first_seen('a')}, '|') as variants from (select o_orderkey,
 list_filter([v, {_DEC}, {_PCT}], lambda e: e is not null) as a from (select o_orderkey, v, v::double as x from
 (select o_orderkey, case when o_orderkey % 2 = 0 then '0.' || lpad(cast(1 + o_custkey % 999 as varchar), 3, '0') || '5' else cast(o_custkey as varchar) || '.' || cast(1 + o_orderkey % 9 as varchar) || '5' end as v from orders)))""")
def _(spark, sf):
    v = F.expr("""case when o_orderkey % 2 = 0 then '0.' || lpad(cast(1 + o_custkey % 999 as string), 3, '0') || '5'
                  else cast(o_custkey as string) || '.' || cast(1 + o_orderkey % 9 as string) || '5' end""")
    t = table(spark, sf, "orders", heavy=True).select("o_orderkey", v.alias("v"))
    return t.select("o_orderkey", F.array_join(DT.value_variants(F.col("v")), "|").alias("variants"))


_CUT = r"case when regexp_replace({0}, '[!-/:-@\[-`{{-~]+$', '') <> {0} and length(regexp_replace({0}, '[!-/:-@\[-`{{-~]+$', '')) > 2 then regexp_replace({0}, '[!-/:-@\[-`{{-~]+$', '') end"


def _joins(w: str) -> str:
    return D.squeeze(f"replace(v, ',', ' {w} ')")


def _tail(g: str) -> str:
    return D.squeeze(f"array_to_string(p[1:len(p) - 1], ', ') || '{g}' || p[len(p)]")


_LISTS = [_tail(g) for g in (" and ", ", and ", " or ", ", or ")]
_ONE = [f"case when k = 1 then {_joins(w)} end" for w in ("and", "or")]
_MANY = [f"case when k >= 2 then {t} end" for t in _LISTS]
_EVERY = [f"case when k >= 2 then {_joins(w)} end" for w in ("and", "or")]
_OPEN = f"case when contains(v, '(') and contains(v, ')') then {D.squeeze(chr(116) + 'ranslate(v, ' + chr(39) + '()' + chr(39) + ', ' + chr(39) + '  ' + chr(39) + ')')} end"
_OUT = r"case when contains(v, '(') and contains(v, ')') and length(trim(regexp_replace(v, '\s*\([^)]*\)', '', 'g'))) > 2 then trim(regexp_replace(v, '\s*\([^)]*\)', '', 'g')) end"
_TEXT_ITEMS = ["v", D.clean_field_string("v"), _CUT.format("v"), _CUT.format(f"({D.clean_field_string('v')})"), *_ONE,
               *[_CUT.format(f"({o})") for o in _ONE], *_MANY, *_EVERY, *[_CUT.format(f"({m})") for m in _MANY],
               f"case when k >= 1 then {D.squeeze(chr(114) + 'eplace(v, ' + chr(39) + ',' + chr(39) + ', ' + chr(39) + ', ' + chr(39) + ')')} end",
               _OPEN, _CUT.format(f"({_OPEN})"), _OUT, _CUT.format(f"({_OUT})")]
_LISTED = """case p_partkey % 5 when 0 then p_name || '!?' when 1 then p_brand || ',' || p_type when 2 then p_name || ', ' || p_brand || ',' || p_type || '.'
 when 3 then p_name || ' (' || p_brand || ')' else p_type end"""


@query("det_2_value_variants_text", f"""select p_partkey, array_to_string({_first_seen('a')}, '|') as variants from (select p_partkey, list_filter([{", ".join(_TEXT_ITEMS)}],
 lambda e: e is not null and e <> '') as a from (select p_partkey, v, string_split(v, ',') as p, length(v) - length(replace(v, ',', '')) as k from (select p_partkey, {_LISTED} as v from part)))""")
def _(spark, sf):
    t = table(spark, sf, "part", heavy=True).select("p_partkey", F.expr(_LISTED).alias("v"))
    return t.select("p_partkey", F.array_join(DT.value_variants(F.col("v")), "|").alias("variants"))


@query("det_3_field_in_sentence_standard", f"""with n as (select *, {_NAME_KIND} as kind from ({_PAIRS_DUCK})), m as (select *,
 case when regexp_matches(value, '^\\d$') then case when regexp_matches(sentence, '(?:^|\\s)' || value || '(?:$|\\s)') then value end
 when {bounded('sentence', 'value')} then case when field = 'category (main)' then lower(value) else value end end as hit from n)
 select row_id, pos, kind <> '' and (hit is not null or kind like 'field_name%') as found, coalesce(case when kind <> '' then hit end, value) as matched_text,
 case when kind <> '' and (hit is not null or kind like 'field_name%') then kind else '' end as match_type from m""")
def _(spark, sf):
    hit = DT.field_in_sentence(F.col("sentence"), F.col("field"), F.col("value"), F.lit("STANDARD"))
    return pairs(spark, sf).select("row_id", "pos", hit.alias("h")).select("row_id", "pos", "h.*")


_STATE = """case c_custkey % 5 when 0 then 'The debtor mark is ' || d || '.' when 1 then 'This debtor is ' || case d when '1' then 'active' else 'inactive' end || '.'
 when 2 then case d when '1' then 'This customer is a debtor today.' else 'This customer is not a debtor' end when 3 then 'The debtor file is closed.' else 'Nothing to see.' end"""


@query("det_3_field_in_sentence_binary", f"""select c_custkey, c_custkey % 5 <> 4 as found, case c_custkey % 5 when 0 then d when 1 then case d when '1' then 'active' else 'inactive' end
 when 2 then case d when '1' then 'is a debtor' else 'this customer is not a debtor' end else d end as matched_text, case when c_custkey % 5 <> 4 then 'field_name_direct' else '' end as match_type
 from (select c_custkey, case when c_acctbal < 0 then '1' else '0' end as d from customer)""")
def _(spark, sf):
    t = table(spark, sf, "customer", heavy=True).select("c_custkey", F.expr("case when c_acctbal < 0 then '1' else '0' end").alias("d"))
    t = t.select("c_custkey", "d", F.expr(_STATE).alias("s"))
    hit = DT.field_in_sentence(F.col("s"), F.lit("debtor"), F.col("d"), F.lit("BINARY"))
    return t.select("c_custkey", hit.alias("h")).select("c_custkey", "h.*")


_MISSING = """case c_custkey % 4 when 0 then 'The channel was left unspecified.' when 1 then 'The channel is NULL.' when 2 then 'Its channel stays open.' else 'No word on it.' end"""


@query("det_3_field_in_sentence_null", """select c_custkey, c_custkey % 4 <> 3 as found, case c_custkey % 4 when 0 then 'unspecified' when 1 then 'null' when 2 then 'not specified' else 'NULL' end as matched_text,
 case when c_custkey % 4 <> 3 then 'field_name_direct' else '' end as match_type from customer""")
def _(spark, sf):
    t = table(spark, sf, "customer", heavy=True).select("c_custkey", F.expr(_MISSING).alias("s"))
    hit = DT.field_in_sentence(F.col("s"), F.lit("channel"), F.lit("NULL"), F.lit("NULL"))
    return t.select("c_custkey", hit.alias("h")).select("c_custkey", "h.*")


_MARKED = """case p_partkey % 4 when 0 then 'The marker reads ' || m || ' here.' when 1 then case m when '+' then 'The marker is positive.' else 'The marker is not available.' end
 when 2 then 'The marker stands.' else 'Nothing.' end"""


@query("det_3_field_in_sentence_misc", """select p_partkey, p_partkey % 4 <> 3 as found, case when p_partkey % 4 = 1 then case m when '+' then 'positive' else 'not available' end else m end as matched_text,
 case when p_partkey % 4 <> 3 then 'field_name_direct' else '' end as match_type from (select p_partkey, case when p_partkey % 3 = 0 then '-' else '+' end as m from part)""")
def _(spark, sf):
    t = table(spark, sf, "part", heavy=True).select("p_partkey", F.expr("case when p_partkey % 3 = 0 then '-' else '+' end").alias("m"))
    t = t.select("p_partkey", "m", F.expr(_MARKED).alias("s"))
    hit = DT.field_in_sentence(F.col("s"), F.lit("marker"), F.col("m"), F.lit("MISC"))
    return t.select("p_partkey", hit.alias("h")).select("p_partkey", "h.*")


@query("det_4_replace_match", """select p_partkey, case p_partkey % 4 when 0 then 'Made by [BRAND_NAME], ' || lower(p_brand) || '.' when 1 then 'x[BRAND_NAME]y' when 2 then 'Made by [BRAND_NAME] now' end as replaced from part""")
def _(spark, sf):
    s = F.expr("""case p_partkey % 4 when 0 then 'Made by ' || p_brand || ', ' || lower(p_brand) || '.' when 1 then 'x' || p_brand || 'y'
                  when 2 then 'Made by ' || upper(p_brand) || ' now' else 'Nobody made it' end""")
    return table(spark, sf, "part", heavy=True).select("p_partkey", DT.replace_match(s, F.lit("brand name"), F.col("p_brand")).alias("replaced"))


def _tagged(spark, sf):
    """Sentences with tags of their (row, field)."""
    p = pairs(spark, sf)
    return p.withColumn("tag", R.make_tag(F.col("row_id").cast("string"), F.col("field"))).withColumn(
        "field_class", F.lit("STANDARD"))


@query("det_5_resolve_by_tag", f"""with n as (select *, {_NAME_KIND} as kind from ({_PAIRS_DUCK})), m as (select *, {bounded('sentence', 'value')} and not (regexp_matches(value, '^\\d$') and
 not regexp_matches(sentence, '(?:^|\\s)' || value || '(?:$|\\s)')) as hit, contains(lower(sentence), lower(value)) as shown from n)
 select row_id, substr(md5(concat_ws('|', cast(row_id as varchar), field)), 1, 16) as tag, field, case when row_id % 4 = 0 then 'known' when field = 'category (main)' and kind <> '' and hit then lower(value) else value end as replacement_value,
 case when row_id % 4 = 0 then 'hash_validated' when kind <> '' and (hit or kind like 'field_name%') and shown then kind else 'needs_regeneration' end as match_type from m""")
def _(spark, sf):
    t = _tagged(spark, sf)
    known = F.when(F.col("row_id") % 4 == 0, "known")
    tags = t.select("row_id", "tag", "field", "value", "field_class", known.alias("replacement"))
    return DT.resolve_by_tag(t.select("row_id", "tag", "sentence"), tags)


_NARR = "'| First note. (Hash: 0a) | Free words. | ' || p_name || ' is sold. (Hash: 1b) | Last. (Hash: 2c)'"


@query("det_6_sentence_by_tag", """select p_partkey, p_name || ' is sold. (Hash: 1b)' as one, 'Last. (Hash: 2c)' as last, 'Plain (Hash: 3d)' as dotted, null::varchar as absent,
 '| First note. (Hash: 0a) | Free words. | New ' || p_brand || '. (Hash: 1b) | Last. (Hash: 2c)' as swapped from part""")
def _(spark, sf):
    t = table(spark, sf, "part", heavy=True).select("*", F.expr(_NARR).alias("n"))
    n = F.col("n")
    new = F.concat(F.lit("New "), "p_brand", F.lit(". (Hash: 1b)"))
    return t.select("p_partkey", DT.sentence_by_tag(n, F.lit("1b")).alias("one"), DT.sentence_by_tag(n, F.lit("2c")).alias("last"),
                    DT.sentence_by_tag(F.lit("Before. Plain (Hash: 3d) after."), F.lit("3d")).alias("dotted"),
                    DT.sentence_by_tag(n, F.lit("ff")).alias("absent"), DT.swap_sentence(n, F.lit("1b"), new).alias("swapped"))


def _classed(spark, sf):
    return pairs(spark, sf).select(
        "*", F.when(F.col("pos") == 3, "COMPLEX").otherwise("STANDARD").alias("field_class"),
        F.concat(F.lit("db"), (F.col("row_id") % 5).cast("string")).alias("database"))


_ANALYSIS = f"""with n as (select *, {_NAME_KIND} as kind, case when pos = 3 then 'COMPLEX' else 'STANDARD' end as field_class, 'db' || cast(row_id % 5 as varchar) as database from ({_PAIRS_DUCK})),
 m as (select *, case when regexp_matches(value, '^\\d$') then regexp_matches(sentence, '(?:^|\\s)' || value || '(?:$|\\s)') else {bounded('sentence', 'value')} end as hit from n),
 f as (select *, pos = 3 or (kind <> '' and (hit or kind like 'field_name%')) as detected from m),
 an as (select *, case when pos = 3 then 'tbd_skipped' when detected then kind else '' end as method, detected and pos <> 3 and contains(lower(sentence), lower(value)) as replaced from f),
 a as (select *, case when method in ('field_name_direct', 'tbd_skipped') then 'high' when method = 'field_name_word_by_word' then 'medium' when method = 'field_value' then 'low' else 'none' end as confidence from an)"""


@query("det_7_analyze_templates", f"{_ANALYSIS} select row_id, pos, detected, method, confidence, replaced from a")
def _(spark, sf):
    return DT.analyze_templates(_classed(spark, sf)).select("row_id", "pos", "detected", "method", "confidence", "replaced")


@query("det_7_table_rates", f"""{_ANALYSIS} select row_id, count(*) as n_columns, count(*) filter (where detected) as n_detected, round(count(*) filter (where detected) * 100.0::double / count(*), 4) as rate from a group by 1""")
def _(spark, sf):
    return DT.table_rates(DT.analyze_templates(_classed(spark, sf)), ["row_id"])


@query("det_8_detection_summary", f"""{_ANALYSIS}, g as (select 'all' as dimension, 'all' as value, * from a union all select 'database', database, * from a union all select 'field_class', field_class, * from a
 union all select 'method', method, * from a union all select 'confidence', confidence, * from a)
 select dimension, value, count(*) as total, count(*) filter (where detected) as detected, count(*) filter (where replaced) as replaced from g group by 1, 2""".replace(
     "select 'all' as dimension, 'all' as value, *", "select 'all' as dimension, 'all' as value, detected, replaced").replace(
     "database, * from", "database, detected, replaced from").replace("field_class, * from", "field_class, detected, replaced from").replace(
     "method, * from", "method, detected, replaced from").replace("confidence, * from", "confidence, detected, replaced from"))
def _(spark, sf):
    return DT.detection_summary(DT.analyze_templates(_classed(spark, sf)))


@query("det_9_problem_tables", f"""{_ANALYSIS} select row_id, round(count(*) filter (where detected) * 100.0::double / count(*), 4) as rate,
 string_agg(field, ',' order by field) filter (where not detected) as undetected from a group by 1 having count(*) filter (where detected) * 100.0 / count(*) < 90""")
def _(spark, sf):
    bad = DT.problem_tables(DT.analyze_templates(_classed(spark, sf)), ["row_id"], 90.0)
    return bad.withColumn("undetected", F.array_join("undetected", ","))


@query("det_10_remediate", f"""{_ANALYSIS} select row_id, pos, case when ok then sentence else 'The ' || field || ' is ' || value || '.' end as sentence, cast(case when ok then 0 else 1 end as integer) as fixed_in
 from (select *, kind <> '' and (hit or kind like 'field_name%') and contains(lower(sentence), lower(value)) as ok from m)""")
def _(spark, sf):
    p = pairs(spark, sf).select("*", F.lit("STANDARD").alias("field_class"))
    return DT.remediate(p, RuleModel()).select("row_id", "pos", "sentence", "fixed_in")


def _longest(items):
    return sorted(items, key=lambda p: (-len(p), p))


@query("det_11_extract_indicator", f"""select c_custkey, case {" ".join(f"when contains(lower(s), {D.q(p)}) then {D.q(p)}" for p in _longest(vocab.IMPLICIT_NULL_PHRASES))} else '' end as indicator
 from (select c_custkey, {_MISSING} || case when c_custkey % 3 = 0 then ' Details not provided, it remains unspecified.' else '' end as s from customer)""")
def _(spark, sf):
    s = F.concat(F.expr(_MISSING), F.expr("case when c_custkey % 3 = 0 then ' Details not provided, it remains unspecified.' else '' end"))
    t = table(spark, sf, "customer").select("c_custkey", s.alias("sentence"))
    return DT.extract_indicator(t, RuleModel()).select("c_custkey", "indicator")


# --- bank building ---------------------------------------------------------------------

_TPL_SRC = """select p_partkey, 'grade ' || cast(p_size as {string}) as field, case when p_partkey % 3 = 0 then cast(p_size as {string}) || '.0' else cast(p_size as {string}) end as value,
 'The grade ' || cast(p_size as {string}) || ' value is ' || cast(p_size as {string}) || ', so Grade-' || cast(p_size as {string}) || '0 or ' || cast(p_size as {string}) || '.' as sentence from {part}"""


@query("gen_20_templatize", """select p_partkey, 'The grade ' || s || ' value is [GRADE ' || s || '], so Grade-' || s || '0 or [GRADE ' || s || '].' as pattern
 from (select p_partkey, cast(p_size as varchar) as s from part)""")
def _(spark, sf):
    t = spark.sql(_TPL_SRC.replace("{string}", "string"), part=table(spark, sf, "part", heavy=True))
    return t.select("p_partkey", DT.templatize(F.col("sentence"), F.col("field"), F.col("value")).alias("pattern"))


# per order: two sentences; detections of three fields in the first and two in the second
def _detections(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.expr("""inline(array(
        struct(0 as pos, 'price' as field, case when o_orderkey % 2 = 0 then 'field_name_direct' else 'field_value' end as match_type, cast(cast(o_totalprice as int) as string) as value),
        struct(0 as pos, 'status' as field, case when o_orderkey % 3 = 0 then 'field_name_direct' else 'field_name_word_by_word' end as match_type, o_orderstatus as value),
        struct(0 as pos, 'customer O' as field, 'field_value' as match_type, cast(o_custkey as string) as value),
        struct(1 as pos, 'price' as field, 'field_name_direct' as match_type, cast(cast(o_totalprice as int) as string) as value),
        struct(1 as pos, 'status' as field, 'field_value' as match_type, o_orderstatus as value)))"""))


# first sentence: price wins when direct and status is not, else status (direct beats; at equal strength the later name)
_FIRST = "case when k % 3 = 0 then 'status' when k % 2 = 0 then 'price' else 'status' end"
_SECOND = f"case when {_FIRST} = 'price' then 'status' else 'price' end"
_ROLES = f"""select k as o_orderkey, cast(pos as integer) as pos, field, case when field = case pos when 0 then {_FIRST} else {_SECOND} end then 'primary' else 'foreign' end as role
 from (select o_orderkey as k from orders), (values (0, 'price'), (0, 'status'), (0, 'customer O'), (1, 'price'), (1, 'status')) v(pos, field)"""


@query("gen_21_assign_roles", _ROLES)
def _(spark, sf):
    return DT.assign_roles(_detections(spark, sf), "o_orderkey").select("o_orderkey", "pos", "field", "role")


# only status 'O' is a word of the name "customer O"; a value may also be contained in another
@query("gen_22_resolve_conflicts", """select o_orderkey, cast(pos as integer) as pos, field from (select o_orderkey, o_orderstatus, pos, field, role from orders,
 (values (0, 'a', 'primary'), (0, 'state', 'foreign'), (0, 'customer O', 'foreign'), (1, 'city', 'foreign'), (1, 'town', 'foreign')) v(pos, field, role))
 where not (pos = 0 and field = 'state' and o_orderstatus = 'O') and not (pos = 1 and case when o_orderkey % 3 = 0 then field = 'city' when o_orderkey % 3 = 1 then field = 'town' else field = 'town' end)""")
def _(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", F.expr("""inline(array(
        struct(0 as pos, 'a' as field, 'field_name_direct' as match_type, 'first' as value, 'primary' as role),
        struct(0 as pos, 'state' as field, 'field_value' as match_type, o_orderstatus as value, 'foreign' as role),
        struct(0 as pos, 'customer O' as field, 'field_value' as match_type, cast(o_custkey as string) as value, 'foreign' as role),
        struct(1 as pos, 'city' as field, case when o_orderkey % 3 = 0 then 'field_value' else 'field_name_direct' end as match_type, 'Rome' as value, 'foreign' as role),
        struct(1 as pos, 'town' as field, case when o_orderkey % 3 = 1 then 'field_value' else 'field_name_direct' end as match_type, 'Rome' as value, 'foreign' as role)))"""))
    return DT.resolve_conflicts(d, "o_orderkey").select("o_orderkey", "pos", "field")


@query("gen_24_templates_from_sentences", """select p_partkey as row_id, cast(pos as integer) as pos, case when pos = 0 then 'p_brand' end as field, pos <> 0 as is_static, cast(vid as integer) as vid,
 case when pos = 0 then 'STANDARD' else 'STANDARD' end as field_class, 'std' as pool, case when vid = 0 then s else before || lower(s[1:1]) || s[2:] end as pattern
 from (select p_partkey, pos, case pos when 0 then 'The maker is [P_BRAND] of course.' when 1 then 'Free words go here.' else 'The size is known well.' end as s from part, (values (0), (1), (4)) v(pos)),
 (values (0, ''), (1, 'In this case, '), (2, 'For the record, ')) f(vid, before)""")
def _(spark, sf):
    part = table(spark, sf, "part", heavy=True)
    s = part.select(F.col("p_partkey").alias("row_id"), F.expr("""inline(array(
        struct(0 as pos, 'The maker is ' || p_brand || ' of course. (Hash: 0a)' as sentence, '0a' as tag, 'p_brand' as field),
        struct(1 as pos, 'Free words go here.' as sentence, cast(null as string) as tag, cast(null as string) as field),
        struct(2 as pos, 'TBD' as sentence, cast(null as string) as tag, cast(null as string) as field),
        struct(3 as pos, '--- 42' as sentence, cast(null as string) as tag, cast(null as string) as field),
        struct(4 as pos, 'The size is known well. (Hash: 1b)' as sentence, '1b' as tag, 'p_size' as field)))"""))
    rows = part.select(F.col("p_partkey").alias("row_id"), F.expr(
        "inline(array(struct('p_brand' as field, p_brand as value, 'STANDARD' as field_class), struct('p_size' as field, cast(p_size as string) as value, 'STANDARD' as field_class)))"))
    return templates_from_sentences(s, rows, RuleModel(), 3).select(
        "row_id", "pos", "field", "is_static", "vid", "field_class", "pool", "pattern")
