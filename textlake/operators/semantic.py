"""Operators over documents: extract, filter, join, aggregate, rank, group and combine.

A document's fields are read back by inverting the wordings of its bank, so every
operator below becomes an ordinary column expression or join that Catalyst plans.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake import vocab
from textlake.functions.sums import exact_sum
from textlake.operators.bank import Bank, Template, cut_wording, normalize_pattern
from textlake.operators.model import RowModel, model_map
from textlake.operators.segment import Wording, segments, value_of, wordings
from textlake.session import cut_lineage

# --- reading values back -------------------------------------------------------------

_BINARY = ("BINARY", "NULLABLE_BINARY")


# a sentence opens the text or a line, or follows a sentence end or a transition
_OPEN = r"(?:^|(?<=\n)|(?<=[.!?,]\s))"


def _wording(text: str, synonyms: dict[str, tuple[str, ...]], opening: bool) -> str:
    """Regex of literal text; words that may have been varied match any of their choices.

    A transition may have lower-cased the first letter of an opening.
    """
    parts, first = [], opening
    for token in re.split(r"(\w+)", text):
        if token.lower() in synonyms:
            choices = sorted({token.lower(), *synonyms[token.lower()]}, key=lambda w: (-len(w), w))
            parts.append("(?i:" + "|".join(map(_quote, choices)) + ")")
        elif first and token[:1].isalpha() and token[0].lower() != token[0].upper():
            parts.append(f"[{token[0].upper()}{token[0].lower()}]" + _quote(token[1:]))
        else:
            parts.append(_quote(token))
        first = first and not token.strip()
    return "".join(parts)


def _quote(text: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", text)


_TRANSITION = "(?:(?:" + "|".join(vocab.TRANSITIONS) + r")\s)?"


def _anchor(text: str, synonyms: dict[str, tuple[str, ...]]) -> tuple[str, str]:
    """``(literal, regex)`` of a sentence opening.

    The literal is a plain text every match holds: a fast test before the regex. The
    regex begins with the literal too where it can, so that the engine searches for it
    as a text, and looks back for the first letter and the sentence boundary.
    """
    varied = [w for w in re.findall(r"\w+", text) if w.lower() in synonyms]
    if not varied and len(text) > 3 and text[0].isalpha():
        rest = _quote(text[1:])
        return text[1:], rest + rf"(?<=(?:^|\n|[.!?,]\s)[{text[0].upper()}{text[0].lower()}]{rest})"
    fixed = re.split("|".join(rf"\b{re.escape(w)}\b" for w in varied), text[1:]) if varied else [text[1:]]
    return max(fixed, key=len), _OPEN + _wording(text, synonyms, True)


def pool_matches(t: Template, contents: Column) -> dict[str, Column]:
    """Per pool of a slot, whether one of its literal wordings is in the text."""
    out = {}
    for pool in ("null", "counter", "std"):
        tests = []
        for p in map(normalize_pattern, t.pool(pool)):
            if not cut_wording(p, t.fields)[1]:
                literal, rx = _anchor(p, t.synonyms)
                tests.append(contents.contains(literal) & contents.rlike(rx + r"(?=\s|$)"))
        if tests:
            out[pool] = reduce(lambda a, b: a | b, tests)
    return out


def _reading(pattern: str, t: Template) -> tuple[str, str, list[str]]:
    """``(literal, regex, fields)`` of a wording with values: a text that every match holds, and a group per field."""
    before, gaps = cut_wording(pattern, t.fields)
    # a value that opens the sentence must not run over a sentence end
    group, shown, rest = "(.*?)" if before.strip() else r"((?:(?![.!?]\s).)*?)", [], ""
    for f, text in gaps:
        rest += (rf"\{shown.index(f) + 1}" if f in shown else group) + _wording(text, t.synonyms, False)
        shown += [] if f in shown else [f]
    literal, opening = _anchor(before, t.synonyms) if before.strip() else ("", _OPEN + _TRANSITION)
    return literal, "(?s)" + opening + rest + r"(?=\s|$)", shown


def _value_of(pattern: str, t: Template, field: str, contents: Column) -> Column:
    """Value of a field shown by one wording, NULL when the text does not hold it."""
    literal, rx, shown = _reading(pattern, t)
    value = F.nullif(F.regexp_extract(contents, rx, shown.index(field) + 1), F.lit(""))
    return F.when(contents.contains(literal), value) if literal else value


def extract_value(t: Template, contents: Column, field: str | None = None) -> Column:
    """Text of a field's value in a document; NULL when missing or not found.

    A wording that does not show the field stands for what its pool means: missing, 0 or 1.
    """
    own, field = field in (None, t.field), field or t.field
    chain = F.when(F.lit(False), F.lit(""))
    meaning = {"null": None, "counter": "0" if own and t.klass in _BINARY else None, "std": "1" if own else None}
    for pool, hit in pool_matches(t, contents).items():
        chain = chain.when(hit, F.lit(meaning[pool]).cast("string"))
    for pool in ("null", "counter", "std"):
        for p in map(normalize_pattern, t.pool(pool)):
            gaps = cut_wording(p, t.fields)[1]
            if gaps and field not in dict(gaps):
                literal, rx, _ = _reading(p, t)
                chain = chain.when(contents.contains(literal) & contents.rlike(rx), F.lit(meaning[pool]).cast("string"))
    cut = [(p, *cut_wording(p, t.fields)) for pool in ("std", "counter", "null") for p in map(normalize_pattern, t.pool(pool))]
    # wordings with the longest start first: a shorter one may be the end of a longer one
    with_value = sorted((c for c in cut if field in dict(c[2])), key=lambda c: -len(c[1]))
    found = [_value_of(p, t, field, contents) for p, _, _ in with_value]
    text = F.coalesce(*found) if found else F.lit(None).cast("string")
    return chain.otherwise(F.when(~F.upper(text).isin([w for w in vocab.NULL_WORDS_RENDER if w]), text))


def slots(bank: Bank) -> dict[str, Template]:
    return {t.field: t for t in bank if t.field}


def _homes(bank: Bank, field: str) -> list[int]:
    """Slots that say a field: the one it is the first field of, then those that show it beside theirs."""
    own = [i for i, t in enumerate(bank) if t.field == field][-1:]
    homes = own + [i for i, t in enumerate(bank) if t.field and t.field != field and field in t.others]
    if not homes:
        raise KeyError(f"no slot of the bank says {field}")
    return homes


def sem_extract(docs: DataFrame, bank: Bank, fields: dict[str, str], noise: list[str] | None = None, plain_values: bool = False) -> DataFrame:
    """Add typed field columns to a document set: ``{"c_acctbal": "double"}``.

    A document is cut as a whole (see ``segment``), so values may hold periods, line breaks and other wordings. With ``noise``, the
    sentences that are neither of the bank nor static slots (none: an empty list), everything between two openings is the
    value. Without it, or with wordings that open with a value, other sentences may stand anywhere, so a value is over at a sentence end that a capital letter follows,
    abbreviations apart. A value that opens its sentence ends at the first period. NULL where a document has no such sentence.

    With ``plain_values`` the caller vouches that no value holds a sentence end (keys, numbers, codes): each wording
    is then read where it is first found, at about half the cost.

    A field that several slots say is read from its own slot, or where that says nothing, from the first other one that shows it.
    """
    homes = {f: _homes(bank, f) for f in fields}
    if plain_values:
        return docs.withColumns({f: F.coalesce(*[extract_value(bank[i], F.col("contents"), f) for i in homes[f]]).try_cast(t)
                                 for f, t in fields.items()})
    known, name, strict = wordings(bank, list(noise or ())), "_segments", noise is not None and not _opened_by_values(bank)
    while name in docs.columns:
        name = "_" + name
    # the row number keeps filters on a value from moving below the alignment and carrying it along
    out = docs.withColumn(name, F.when(F.monotonically_increasing_id() >= 0, segments(F.col("contents"), known, strict)))
    return out.withColumns({f: F.coalesce(*[_said(out[name], bank[i], i, known, strict, f) for i in homes[f]]).try_cast(t)
                            for f, t in fields.items()}).drop(name)


def _opened_by_values(bank: Bank) -> bool:
    """Whether a wording opens with a value, so that its sentences cannot be told from others beforehand."""
    return any(gaps and not before.strip() for t in bank for pool in ("std", "counter", "null")
               for before, gaps in (cut_wording(p, t.fields) for p in map(normalize_pattern, t.pool(pool))))


def _said(seg: Column, t: Template, slot: int, known: list[Wording], strict: bool, field: str) -> Column:
    """Text of a field's value in one slot, NULL for words that mean a missing value."""
    text = value_of(seg, t, slot, known, _BINARY, strict, field)
    text = F.when(~F.upper(text).isin([w for w in vocab.NULL_WORDS_RENDER if w]), text)
    cut = [cut_wording(p, t.fields) for pool in ("std", "counter", "null") for p in map(normalize_pattern, t.pool(pool))]
    if any(field in dict(gaps) and not before.strip() for before, gaps in cut):
        text = F.coalesce(text, extract_value(t, F.col("contents"), field))
    return text


def extraction_conflicts(docs: DataFrame, bank: Bank, noise: list[str] = ()) -> DataFrame:
    """``row_id, field``: documents that can be read in several equally good ways (field NULL), fields of which
    wordings of more than one pool are found, and fields of a sentence with several values that can be parted in several ways."""
    checks = [F.when(reduce(lambda a, b: a + b, [h.cast("int") for h in hits.values()]) > 1, F.lit(f))
              for f, t in slots(bank).items() if len(hits := pool_matches(t, F.col("contents"))) > 1]
    known, name = wordings(bank, list(noise)), "_segments"
    while name in docs.columns:
        name = "_" + name
    strict = not _opened_by_values(bank)
    cut = docs.withColumn(name, segments(F.col("contents"), known, strict))
    for i, t in enumerate(bank):
        for f in t.fields if any(w.slot == i and len(w.gaps) > 1 for w in known) else ():
            shortest, longest = (value_of(cut[name], t, i, known, _BINARY, strict, f, g) for g in (False, True))
            checks.append(F.when(~shortest.eqNullSafe(longest), F.lit(f)))
    unsure = F.when(cut[name]["found"]["ambiguous"], F.array(F.lit(None).cast("string")))
    found = F.concat(F.coalesce(unsure, F.expr("cast(array() as array<string>)")), F.array_distinct(F.array_compact(F.array(*checks))) if checks else F.expr("cast(array() as array<string>)"))
    return cut.select("row_id", F.explode(found).alias("field"))


# --- row operators -------------------------------------------------------------------

def sem_filter(docs: DataFrame, predicate: Column | str) -> DataFrame:
    """Keep documents whose extracted fields satisfy the condition."""
    return docs.where(predicate)


def sem_filter_model(docs: DataFrame, prompt: Column, model: RowModel, cache: DataFrame | None = None,
                     cache_path: str | None = None) -> DataFrame:
    """Keep documents for which the model answers true or yes."""
    asked = model_map(docs.withColumn("_prompt", prompt), "_prompt", model, "_answer", cache, cache_path)
    yes = F.upper(F.trim("_answer")).isin(vocab.TRUE_WORDS)
    return asked.where(yes).drop("_prompt", "_answer")


def sem_map(docs: DataFrame, name: str, expression: Column | str) -> DataFrame:
    return docs.withColumn(name, F.expr(expression) if isinstance(expression, str) else expression)


# --- joins ---------------------------------------------------------------------------

def sem_join(left: DataFrame, right: DataFrame, on: tuple[str, str], how: str = "inner") -> DataFrame:
    """Pair documents that describe the same key: an equi-join on extracted keys.

    Columns both sides have get ``_left`` and ``_right``.
    """
    shared = [c for c in left.columns if c in right.columns]
    lk, rk = (f"{on[0]}_left" if on[0] in shared else on[0]), (f"{on[1]}_right" if on[1] in shared else on[1])
    le = left.withColumnsRenamed({c: f"{c}_left" for c in shared})
    ri = right.withColumnsRenamed({c: f"{c}_right" for c in shared})
    return le.join(ri, F.col(lk) == F.col(rk), how)


def merge_joined(joined: DataFrame) -> DataFrame:
    """One document per pair: left text, blank line, right text; the left side's identity.

    Field columns of both sides stay, so that joins can be chained: of a name that both sides
    have, the left one keeps it and the right one gets ``right_`` before it.
    """
    text = F.concat_ws("\n\n", "contents_left", "contents_right")
    both = {c.removesuffix("_left") for c in joined.columns
            if c.endswith("_left") and f"{c.removesuffix('_left')}_right" in joined.columns}
    names = {f"{b}_left": b for b in both}
    taken = {names.get(c, c) for c in joined.columns}
    for base in sorted(both):
        name = f"right_{base}"
        while name in taken:
            name = f"right_{name}"
        taken.add(name)
        names[f"{base}_right"] = name
    keep = [F.col(f"`{c}`").alias(names.get(c, c)) for c in joined.columns if c not in ("contents_left", "contents_right")]
    return joined.select(*keep, text.alias("contents"))


def join_chain(first: DataFrame, rest: list[tuple[DataFrame, tuple[str, str], str]]) -> DataFrame:
    """Left-deep chain of joins; each step gives (documents, key pair, join type)."""
    return reduce(lambda acc, step: merge_joined(sem_join(acc, *step)), rest, first)


def sem_semi(left: DataFrame, right: DataFrame, on: tuple[str, str]) -> DataFrame:
    keys = right.select(F.col(on[1]).alias("_k"))
    return left.join(keys, F.col(on[0]) == F.col("_k"), "left_semi")


def sem_anti(left: DataFrame, right: DataFrame, on: tuple[str, str]) -> DataFrame:
    keys = right.select(F.col(on[1]).alias("_k"))
    return left.join(keys, F.col(on[0]) == F.col("_k"), "left_anti")


# --- aggregates ----------------------------------------------------------------------

def aggregate_of(func: str, field: str | None) -> Column:
    """Aggregate column; sums and averages do not depend on the order of rows."""
    func = func.lower()
    if func == "count":
        return F.count(F.lit(1) if field in (None, "*") else F.col(field))
    if func == "sum":
        return exact_sum(F.col(field))
    if func == "avg":
        return F.try_divide(exact_sum(F.col(field)), F.count(field))
    return {"min": F.min, "max": F.max, "count distinct": F.countDistinct}[func](field)


def sem_agg(docs: DataFrame, aggs: dict[str, Column | tuple[str, str | None]], group: list[str] | None = None) -> DataFrame:
    """Aggregates over all documents, or per group when a grouping key was extracted."""
    columns = [(aggregate_of(*a) if isinstance(a, tuple) else a).alias(name) for name, a in aggs.items()]
    return docs.groupBy(*group).agg(*columns) if group else docs.agg(*columns)


SortKey = str | tuple[str, str] | tuple[str, str, str]


def sort_keys(by: SortKey | list[SortKey], ascending: bool = False) -> list[Column]:
    """Sort columns of ``field``, ``(field, "asc" | "desc")`` or ``(field, direction, "first" | "last")``; NULL is last unless said."""
    out = []
    for key in by if isinstance(by, list) else [by]:
        field, direction, nulls = (*((key,) if isinstance(key, str) else key), None, None)[:3]
        up = ascending if direction is None else direction == "asc"
        out.append(getattr(F.col(field), f"{'asc' if up else 'desc'}_nulls_{nulls or 'last'}")())
    return out


def sem_topk(docs: DataFrame, by: SortKey | list[SortKey], k: int = 1, ascending: bool = False, tie: str = "row_id") -> DataFrame:
    """Best k documents by one or several fields, ties by key where the documents have it."""
    return docs.orderBy(*sort_keys(by, ascending), *([tie] if tie in docs.columns else [])).limit(k)


def sem_topk_in(docs: DataFrame, group: list[str], by: SortKey | list[SortKey], k: int = 1, ascending: bool = False, tie: str = "row_id",
                buckets: int = 64) -> DataFrame:
    """Best k documents of each group, ties by key where the documents have it; NULL keys are a group.

    The best of each (group, bucket) are found first and hold the best of the group, so a group with most of all
    documents is ordered in many tasks.
    """
    order = [*sort_keys(by, ascending), *([F.col(tie)] if tie in docs.columns else [])]
    names = {n: n for n in ("_bucket", "_place")}
    for n in names:
        while names[n] in docs.columns:
            names[n] = "_" + names[n]
    bucket, place = names.values()
    spread = docs.withColumn(bucket, F.pmod(F.xxhash64(tie if tie in docs.columns else F.struct(*docs.columns)), F.lit(buckets)))
    few = spread.withColumn(place, F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order))).where(F.col(place) <= k).drop(bucket)
    return few.withColumn(place, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(place) <= k).drop(place)


def sem_filter_in(docs: DataFrame, group: list[str], aggs: dict[str, Column | tuple[str, str | None]], predicate: Column | str) -> DataFrame:
    """Keep documents whose fields satisfy a condition that also names aggregates of their own group; NULL keys are a group.

    Aggregates are combined map-side and joined back by group, so no group has to be in one task.
    """
    keys = [f"_key_{i}_" for i in range(len(group))]
    sums = sem_agg(docs, aggs, group).withColumnsRenamed(dict(zip(group, keys)))
    same = reduce(lambda a, b: a & b, [F.col(f"`{g}`").eqNullSafe(F.col(k)) for g, k in zip(group, keys)])
    return docs.join(sums, same).where(predicate).drop(*keys, *aggs)


def group_label(keys: list[str]) -> Column:
    """Group keys as one text that no other group has; empty without keys."""
    texts = [F.col(k).cast("string") for k in keys]
    escaped = [F.when(t.isNull(), "").when(t == "", "\\E").otherwise(F.regexp_replace(t, r"([\\|])", r"\\$1")) for t in texts]
    return F.concat_ws("|", *escaped) if keys else F.lit("")


def sem_cluster_by(docs: DataFrame, keys: list[str], name: str = "group_key") -> DataFrame:
    """Group documents by extracted keys; later aggregates use the group column.

    Keys are joined by ``|``; a ``|`` or backslash of a key gets a backslash, empty text is ``\\E`` and NULL is empty.
    """
    return docs.withColumn(name, group_label(keys))


def ungroup(docs: DataFrame, name: str = "group_key") -> DataFrame:
    return docs.drop(name)


def cluster_by_similarity(vectors: DataFrame, vector: str, k: int = 2, seed: int = 1) -> tuple[DataFrame, list[list[float]]]:
    """K-means over embedding arrays: assignments and the k centroids."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    ready = vectors.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, predictionCol="cluster").fit(ready)
    return model.transform(ready).drop("features"), [list(map(float, c)) for c in model.clusterCenters()]


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def assign_to_centroids(vectors: DataFrame, vector: str, centroids: list[list[float]]) -> DataFrame:
    """Nearest of a few centroids, ties to the first; centroids are literals, so nothing moves."""
    v = F.col(vector).cast("array<double>")
    scored = [F.struct(squared_distance(v, F.array(*[F.lit(float(x)) for x in c])).alias("d"), F.lit(i).alias("i"))
              for i, c in enumerate(centroids)]
    return vectors.withColumn("cluster", F.least(*scored)["i"] if len(scored) > 1 else F.lit(0))


def sem_dedup(docs: DataFrame, keys: list[str], order: str = "row_id") -> DataFrame:
    """One document per key, the first by order; combined map-side, so a hot key is small."""
    rest = [c for c in docs.columns if c not in keys]
    first = F.min_by(F.struct(*rest), order)
    return docs.groupBy(*keys).agg(first.alias("_r")).select(*keys, "_r.*")


def sem_setop(a: DataFrame, b: DataFrame, kind: str, distinct: bool = True) -> DataFrame:
    """UNION, INTERSECT or EXCEPT of extracted keys."""
    if kind == "union":
        return a.union(b).distinct() if distinct else a.union(b)
    if kind == "intersect":
        return a.intersect(b) if distinct else a.intersectAll(b)
    return a.subtract(b) if distinct else a.exceptAll(b)


def bind_subquery(result: DataFrame) -> Column:
    """One-row, one-column result as a scalar inside another plan."""
    return result.scalar()


# --- declared steps ------------------------------------------------------------------

_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<>": lambda a, b: a != b, ">": lambda a, b: a > b,
    "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b,
    "like": lambda a, b: F.like(a, b),
}


def _condition(step: dict, scalars: dict[str, Column]) -> Column:
    if "where" in step:
        return F.expr(step["where"])
    value = step["value"]
    bound = scalars[value] if isinstance(value, str) and value in scalars else F.lit(value)
    return _COMPARE[step["cmp"]](F.col(step["field"]), bound)


def _aggregated(docs: DataFrame, step: dict, group: list[str]) -> DataFrame:
    """Group keys and ``value`` of an aggregate step."""
    column = step["column"] if "column" in step else aggregate_of(step["func"], step.get("field"))
    rows = (docs.groupBy(*group) if group else docs).agg(column.alias("value"))
    rows = rows.where(step["having"]) if "having" in step else rows
    rows = rows.orderBy(*sort_keys(step["order"])) if "order" in step else rows
    return rows.limit(step["limit"]) if "limit" in step else rows


def _final_value(step: dict, docs: DataFrame, group: list[str]) -> DataFrame:
    """Rows ``(group_key, answer)`` of one final step.

    An aggregate step may hold ``having`` (a condition), ``order`` (sort keys) and ``limit``
    over the group keys and ``value``, the aggregate. Keys read as those of ``sem_cluster_by``.
    """
    label = group_label(group)
    if step["op"] == "agg":
        rows = _aggregated(docs, step, group)
        return rows.select(label.alias("group_key"), F.col("value").cast("string").alias("answer"))
    return docs.select(label.alias("group_key"), F.col(step["field"]).cast("string").alias("answer"))


_STEPS = {"subquery", "filter", "join", "semi", "anti", "group", "map", "dedup", "topk", "setop", "agg", "extract"}


def _filtered(docs: DataFrame, step: dict, scalars: dict[str, Column], lists: dict[str, DataFrame]) -> DataFrame:
    """``in`` and ``not_in`` name a sub-query of many rows; other conditions are columns. NULL is not in a list, nor outside it."""
    for word, keep in (("in", sem_semi), ("not_in", sem_anti)):
        if word in step:
            return keep(docs.where(F.col(step["field"]).isNotNull()), lists[step[word]], (step["field"], "answer"))
    return sem_filter(docs, _condition(step, scalars))


def run_steps(tables: dict[str, DataFrame], steps: list[dict]) -> list[DataFrame]:
    """Run a declared list of steps; one lazy result per final step, in order.

    Order of work: sub-queries, filters of a single table, joins, remaining filters,
    grouping, top-k, finals. Catalyst sees one plan per result. A sub-query with ``many`` is a
    list for ``in`` filters; ``setop`` combines the named fields with those of another table. After a ``group`` step, top-k and
    filters with ``"per": "group"`` work inside each group; such a filter names aggregates of the group (``aggs``) in ``where``.
    """
    docs, group = _worked(tables, steps)
    return [_final_value(s, docs, group) for s in steps if s["op"] in ("agg", "extract")]


def _bound(tables: dict[str, DataFrame], steps: list[dict]) -> tuple[dict[str, Column], dict[str, DataFrame]]:
    """Sub-queries of the steps: one-row results as scalars, those with ``many`` as lists."""
    scalars: dict[str, Column] = {}
    lists: dict[str, DataFrame] = {}
    for s in steps:
        if s["op"] == "subquery":
            result = run_steps(tables, s["steps"])[0]
            typed = result.select(F.col("answer").cast(s.get("type", "double")).alias("answer"))
            if s.get("many"):
                lists[s["name"]] = typed.distinct()
            else:
                scalars[s["name"]] = typed.scalar()
    return scalars, lists


def _worked(tables: dict[str, DataFrame], steps: list[dict], group: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Documents after all steps but the finals, and the keys they are grouped by (``group`` before a group step)."""
    if unknown := {s["op"] for s in steps} - _STEPS:
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    scalars, lists = _bound(tables, steps)
    sets = dict(tables)
    for s in steps:
        if s["op"] == "filter" and s.get("table"):
            sets[s["table"]] = _filtered(sets[s["table"]], s, scalars, lists)
    docs = sets[next((s["left"] for s in steps if s["op"] == "join"), next(iter(sets)))]
    for s in steps:
        if s["op"] == "join":
            docs = merge_joined(sem_join(docs, sets[s["right"]], s["on"], s.get("how", "inner")))
        elif s["op"] in ("semi", "anti"):
            docs = (sem_semi if s["op"] == "semi" else sem_anti)(docs, sets[s["right"]], s["on"])
    group = list(group or [])
    for s in steps:
        if s["op"] == "filter" and s.get("per") == "group":
            docs = sem_filter_in(docs, group, s["aggs"], s["where"])
        elif s["op"] == "filter" and not s.get("table"):
            docs = _filtered(docs, s, scalars, lists)
        elif s["op"] == "topk" and s.get("per") == "group":
            docs = sem_topk_in(docs, group, s["by"], s.get("k", 1), s.get("ascending", False))
        elif s["op"] == "group":
            group = s["keys"]
        elif s["op"] == "map":
            docs = sem_map(docs, s["name"], s["expression"])
        elif s["op"] == "dedup":
            docs = sem_dedup(docs, s["keys"])
        elif s["op"] == "topk":
            docs = sem_topk(docs, s["by"], s.get("k", 1), s.get("ascending", False))
        elif s["op"] == "setop":
            docs = sem_setop(docs.select(*s["fields"]), sets[s["right"]].select(*s.get("right_fields", s["fields"])),
                             s["kind"], s.get("distinct", True))
    return docs, group


def _folds(steps: list[dict]) -> bool:
    """Whether a branch is only conditions on columns and a plain aggregate, so that it can be folded into one pass over its trunk."""
    *work, last = steps
    return (last["op"] == "agg" and not {"column", "having", "order", "limit"} & last.keys()
            and all(s["op"] == "subquery" and not s.get("many")
                    or s["op"] == "filter" and not {"table", "per", "in", "not_in"} & s.keys() for s in work))


def run_graph(tables: dict[str, DataFrame], trunk: list[dict], branches: dict[str, list[dict]],
              post: dict[str, Callable[..., Column]] | None = None) -> DataFrame:
    """Branches with steps of their own over one trunk: a row per group, a column per branch.

    The trunk's steps run once and are stored. A branch is a list of steps that ends with one ``agg``; the trunk is its
    table ``trunk`` and the trunk's grouping holds. Branches that are conditions and an aggregate share a single pass over the stored
    trunk; one with joins, list sub-queries or steps inside groups reads it for itself. All meet in a union that is
    grouped by key once, whatever their number, so NULL keys meet too.

    A group whose documents a branch drops counts 0, other aggregates of it are NULL; a branch's own ``having``, ``order`` and ``limit`` choose
    groups in the same way. Branches add no groups, and may not group anew. Values are doubles, or of the ``type`` of the
    final step. ``post`` makes further columns of branch columns, named as the parameters of its functions.
    """
    if wrong := [n for n, steps in branches.items() if sum(s["op"] in ("agg", "extract") for s in steps) != 1 or steps[-1]["op"] != "agg"
                 or any(s["op"] == "group" for s in steps)]:
        raise ValueError(f"branches must end with their only final, an aggregate, and keep the trunk's groups: {wrong}")
    docs, group = _worked(tables, trunk)
    docs = cut_lineage(docs)
    tables = {t: d for t, d in tables.items() if t != "trunk"}
    sets = {"trunk": docs, **tables}
    prefix = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in [*docs.columns, *branches]), default=0))
    keys = [f"{prefix}key_{i}" for i in range(len(group))]
    folded = {n: steps for n, steps in branches.items() if _folds(steps)}
    wide, sums = docs, [F.lit(None).cast("string").alias(f"{prefix}none")]
    for i, (name, steps) in enumerate(folded.items()):
        scalars, last, held = _bound(sets, steps)[0], steps[-1], F.lit(True)
        for s in steps:
            held = held & F.coalesce(_condition(s, scalars), F.lit(False)) if s["op"] == "filter" else held
        value = F.lit(1) if last.get("field") in (None, "*") else F.col(last["field"])
        wide = wide.withColumn(f"{prefix}value_{i}", F.when(held, value))
        sums.append(aggregate_of(last["func"], f"{prefix}value_{i}").cast("string").alias(name))
    first = wide.groupBy(*[F.col(g).alias(k) for g, k in zip(group, keys)]).agg(*sums)
    parts = [first.select(*keys, F.lit(True).alias(f"{prefix}base"), *[F.col(n) if n in folded else F.lit(None).cast("string").alias(n) for n in branches])]
    keyed = {"trunk": docs.withColumns({k: F.col(g) for g, k in zip(group, keys)}), **tables}
    for name, steps in branches.items():
        if name not in folded:
            rows, _ = _worked(keyed, steps, keys)
            answers = _aggregated(rows, steps[-1], keys)
            parts.append(answers.select(*keys, F.lit(False).alias(f"{prefix}base"), *[
                (F.col("value").cast("string") if n == name else F.lit(None).cast("string")).alias(n) for n in branches]))
    merged = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(
        F.bool_or(f"{prefix}base").alias(f"{prefix}base"), *[F.max(n).alias(n) for n in branches]).where(f"{prefix}base")
    typed = {n: F.col(n).cast(steps[-1].get("type", "double")) for n, steps in branches.items()}
    empty = {n: F.coalesce(c, F.lit(0).cast(branches[n][-1].get("type", "double"))) if str(branches[n][-1].get("func")).startswith("count") else c
             for n, c in typed.items()}
    out = merged.select(*[F.col(k).alias(g) for g, k in zip(group, keys)], *[c.alias(n) for n, c in empty.items()])
    return out.withColumns({n: make(*[F.col(b) for b in inspect.signature(make).parameters]) for n, make in (post or {}).items()})


def run_branches(trunk: DataFrame, branches: dict[str, tuple[Column | None, str, str | None]],
                 group: list[str] | None = None) -> DataFrame:
    """Several branches over one trunk in a single pass.

    A branch is (condition, function, field): the aggregate over the trunk rows that
    satisfy the condition; a branch without condition is the trunk itself.
    """
    conditions = {name: F.lit(True) if b[0] is None else F.coalesce(b[0], F.lit(False)) for name, b in branches.items()}
    wide = trunk.withColumns({
        f"_{name}": F.when(conditions[name], F.lit(1) if b[2] is None else F.col(b[2])) for name, b in branches.items()})
    columns = [aggregate_of(b[1], f"_{name}").alias(name) for name, b in branches.items()]
    return wide.groupBy(*group).agg(*columns) if group else wide.agg(*columns)


def answer_rows(finals: list[DataFrame]) -> DataFrame:
    """``(ix, group_key, answer)`` of all finals; infinities, NaN and divisions of or by 0 are dropped."""
    rows = reduce(DataFrame.unionByName, [f.withColumn("ix", F.lit(i)) for i, f in enumerate(finals)])
    bad = (F.lower("answer").isin("inf", "-inf", "infinity", "-infinity", "nan", "none")
           | F.col("answer").rlike(r"^n\s*[:/]\s*0$"))
    return rows.where(F.col("answer").isNotNull() & ~bad)


def collect_answers(finals: list[DataFrame]) -> DataFrame:
    """The answer rows as one ordered array: for results a reader looks at, not for document sets."""
    ordered = F.array_sort(F.collect_list(F.struct("ix", "group_key", "answer")))
    return answer_rows(finals).agg(ordered.alias("a")).select(F.transform("a", lambda x: x["answer"]).alias("answers"))


def supported_steps(steps: DataFrame, capabilities: DataFrame, backend: str) -> tuple[DataFrame, DataFrame]:
    """Questions all of whose step types a back end has, and counts of kept and skipped."""
    able = capabilities.where(F.col("backend") == backend).select("op_type", F.lit(1).alias("_ok")).distinct()
    per_question = (steps.join(able, "op_type", "left").groupBy("question_id")
                    .agg(F.bool_and(F.col("_ok").isNotNull()).alias("supported")))
    counts = per_question.groupBy("supported").agg(F.count("*").alias("n"))
    return per_question.where("supported").select("question_id"), counts


def nl_steps(steps: DataFrame, text: Column, cache: DataFrame | None = None) -> DataFrame:
    """Instruction per step: the stored text when there is one, else the worded step."""
    worded = steps.withColumn("_text", text)
    if cache is not None:
        stored = cache.select("question_id", "op_index", F.col("instruction").alias("_stored"))
        worded = worded.join(stored, ["question_id", "op_index"], "left")
    else:
        worded = worded.withColumn("_stored", F.lit(None).cast("string"))
    return worded.withColumn("instruction", F.coalesce("_stored", "_text")).drop("_text", "_stored")
