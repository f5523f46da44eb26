"""The rendering rules as SQL text for the comparison engine."""

from __future__ import annotations

from textlake import vocab
from textlake.operators.bank import Bank, Template, normalize_pattern, placeholder
from textlake.plans import ducksql as D


def draw(n: int | str, *parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT % {n})"


def listed(items) -> str:
    return "[" + ", ".join(D.q(i) for i in items) + "]"


def formatted(col: str, kind: str) -> str:
    if kind == "double":
        return (f"(case when {col} is null then 'NULL' when {col} = floor({col}) then case when {col} = 0 then '0' "
                f"else printf('%.0f', {col}) end else printf('%.2f', {col}) end)")
    if kind == "int":
        return f"coalesce(cast({col} as varchar), 'NULL')"
    return D.format_value(col, col)


def pool_of(value: str, t: Template) -> str:
    up = f"upper(trim(coalesce({value}, 'NULL')))"
    missing, false = f"{up} in ({D.words(vocab.NULL_WORDS_RENDER)})", f"{up} in ({D.words(vocab.FALSE_WORDS)})"
    rules = {"NULLABLE_BINARY": [(missing, "null"), (false, "counter")], "NULL": [(missing, "counter")],
             "BINARY": [(false, "counter")]}.get(t.klass, [])
    whens = " ".join(f"when {test} then '{name}'" for test, name in rules if t.pool(name))
    return f"(case {whens} else 'std' end)" if whens else "'std'"


def slot(t: Template, kinds: dict[str, str], key: str, seed: str, ordinal: str | None = None) -> str:
    label = D.q(t.field or "static")

    def worded(pool) -> str:
        index = (draw(len(pool), D.q(seed), key, label) if ordinal is None
                 else f"(({ordinal} + {draw(len(pool), D.q(seed), label)}) % {len(pool)})")
        patterns = [normalize_pattern(p) for p in pool]
        out = f"{listed(patterns)}[1 + {index}]"
        for f, kind in kinds.items():
            if any(placeholder(f) in p for p in patterns):
                out = f"replace({out}, '{placeholder(f)}', {formatted(f, kind)})"
        return out

    if t.field is None:
        return worded(t.std)
    pool = pool_of(f"cast({t.field} as varchar)", t)
    whens = " ".join(f"when '{name}' then {worded(t.pool(name))}" for name in ("counter", "null") if t.pool(name))
    return f"(case {pool} {whens} else {worded(t.std)} end)" if whens else worded(t.std)


def swap(s: str, word: str, repl: str) -> str:
    for found, put in ((word.upper(), repl.upper()), (word.capitalize(), repl.capitalize()), (word, repl)):
        s = f"regexp_replace({s}, '\\b{found}\\b', '{put}', 'g')"
    return f"regexp_replace({s}, '\\b{word}\\b', '{repl}', 'gi')"


def lexical(s: str, t: Template, kinds: dict[str, str], key: str, seed: str) -> str:
    """``s`` must be a column name: one synonym slot per template is supported here."""
    held = "lower(concat_ws(chr(1), " + ", ".join(formatted(f, k) for f, k in kinds.items()) + "))"
    out = s
    for word, options in t.synonyms.items():
        choices = [word, *[o for o in options if o != word]]
        idx = draw(len(choices), D.q(seed), key, D.q(word))
        whens = " ".join(f"when {i} then {swap(out, word, c)}" for i, c in enumerate(choices) if i)
        out = (f"(case when not regexp_matches({out}, '(?i)\\b{word}\\b') or contains({held}, '{word}') then {out} "
               f"else case {idx} {whens} else {out} end end)")
    return out


def sentences_cte(source: str, bank: Bank, kinds: dict[str, str], key: str, seed: str = "s0",
                  ordinal: str | None = None, carry: str = "") -> str:
    """CTEs ending in ``sents(row_id, sentences, ...)``."""
    k = f"cast({key} as varchar)"
    raw = ", ".join(f"{slot(t, kinds, k, seed, ordinal)} as w{i}" for i, t in enumerate(bank))
    lex = ", ".join(f"{lexical(f'w{i}', t, kinds, k, seed)} as x{i}" for i, t in enumerate(bank))
    clean = ", ".join(D.clean_sentence(f"x{i}") for i in range(len(bank)))
    return (f"src as ({source}), raw as (select *, {raw} from src), lex as (select *, {lex} from raw), "
            f"sents as (select {key} as row_id, [{clean}] as sentences{carry} from lex)")


def noise_count(n: str, x: int, y: int) -> str:
    return "0" if y == 0 else f"greatest({y}, cast(ceil({n} * {y} / {float(x)}) as int))"


def weave(s: str, noise: list[str], x: int, y: int, key: str, seed: str = "s0") -> str:
    if y == 0:
        return s
    n, q = f"len({s})", noise_count(f"len({s})", x, y)
    pick = f"{listed(noise)}[1 + {draw(len(noise), D.q(seed), key, D.q('noise'), 'cast(j as varchar)')}]"
    return (f"(case when {n} > 0 then flatten(list_transform(range({n}), lambda i: list_concat([{s}[i + 1]], "
            f"list_transform(list_filter(range({q}), lambda j: j * {n} // {q} = i), lambda j: {pick})))) else {s} end)")


def assemble(s: str, key: str, seed: str = "s0", share: int = 3) -> str:
    """``s`` must be a column name."""
    length = f"({draw(3, D.q(seed), key, D.q('paragraph'))} + 2)"
    i = "cast(i as varchar)"
    bare = "(" + " or ".join(f"starts_with(lower({s}[i + 1]), '{w}')" for w in vocab.NO_TRANSITION_STARTS) + ")"
    wanted = f"(i % {length} > 0 and {draw(10, D.q(seed), key, D.q('transition'), i)} < {share} and not {bare})"
    words = f"{listed(vocab.TRANSITIONS)}[1 + {draw(len(vocab.TRANSITIONS), D.q(seed), key, D.q('word'), i)}]"
    low = f"lower({s}[i + 1][1:1]) || {s}[i + 1][2:]"
    gap = f"case when i = 0 then '' when i % {length} = 0 then chr(10) || chr(10) else ' ' end"
    return (f"array_to_string(list_transform(range(len({s})), lambda i: {gap} || case when {wanted} then {words} || ' ' || {low} "
            f"else {s}[i + 1] end), '')")


def documents_sql(source: str, bank: Bank, kinds: dict[str, str], key: str, table: str, seed: str = "s0",
                  noise: list[str] | None = None, ratio: tuple[int, int] = (1, 0), ordinal: str | None = None) -> str:
    """CTEs ending in ``docs(row_id, filename, sentences, contents)``."""
    k = "cast(row_id as varchar)"
    return (f"{sentences_cte(source, bank, kinds, key, seed, ordinal)}, "
            f"woven as (select row_id, {weave('sentences', noise or [], *ratio, k, seed)} as sentences from sents), "
            f"docs as (select row_id, '{table}' || {k} || '.txt' as filename, sentences, {assemble('sentences', k, seed)} as contents from woven)")


CUSTOMER_KINDS = {"c_custkey": "int", "c_name": "string", "c_nationkey": "int", "c_mktsegment": "string",
                  "c_acctbal": "double", "is_debtor": "int", "channel": "string", "opted_in": "int"}
ORDER_KINDS = {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "string", "o_totalprice": "double",
               "o_orderdate": "string", "o_orderpriority": "string"}
