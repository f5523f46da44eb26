"""SQL text of the text rules, written for the comparison engine (RE2 regexes)."""

from __future__ import annotations

from textlake import vocab


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def words(items: list[str]) -> str:
    return ", ".join(q(w) for w in items)


SP = r"[\s\p{Z}]+"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SP}', ' ', 'g'))"


def clean_field_string(x: str) -> str:
    bare = f"translate(translate(regexp_replace({x}, '<[^>]+>', '', 'g'), '\\/', '  '), '\"''`', '')"
    return squeeze(bare)


def strip_tags(x: str) -> str:
    return rf"replace(regexp_replace({x}, '\s*\(Hash:\s*[a-f0-9]+\)', '', 'g'), '|', '')"


def number(x: str) -> str:
    return f"(case when regexp_matches({x}, {q(vocab.NUMBER)}) then try_cast(trim({x}) as double) end)"


def plain_number(x: str, text: str) -> str:
    return (f"(case when {x} is null then {text} when {x} = floor({x}) then "
            f"case when {x} = 0 then '0' else printf('%.0f', {x}) end else printf('%.2f', {x}) end)")


def format_value(field: str, text: str, style: str = "render") -> str:
    text = f"coalesce({text}, 'NULL')"
    x = number(text)
    plain = plain_number(x, text)
    if "percent" not in field.lower() and "%" not in field:
        return plain
    scaled = f"(case when {x} between 0 and 1 then {x} * 100 when {x} > 1 then {x} end)"
    if style == "raw":
        shown = f"{plain_number(scaled, text)} || '%'"
    else:
        shown = f"printf('%.{1 if style == 'render' else 2}f', {scaled}) || '%'"
    return f"(case when {scaled} is not null then {shown} else {plain} end)"


def humanize_column(x: str) -> str:
    return f"trim(replace(split_part({x}, '.', -1), '_', ' '))"


def humanize_date(x: str) -> str:
    months = "[" + words(vocab.MONTHS) + "]"
    t = f"trim({x})"
    full, short, compact = (r"^(\d{4})-(0[1-9]|1[0-2])-(\d{2})$", r"^(\d{4})-(0[1-9]|1[0-2])-?$",
                            r"^(\d{4})(0[1-9]|1[0-2])$")

    def part(p: str, g: int) -> str:
        return f"regexp_extract({t}, '{p}', {g})"

    def month(p: str) -> str:
        return f"{months}[try_cast({part(p, 2)} as int)]"

    return (f"(case when regexp_matches({t}, '{full}') then {month(full)} || ' ' || "
            f"cast(try_cast({part(full, 3)} as int) as varchar) || ', ' || {part(full, 1)} "
            f"when regexp_matches({t}, '{short}') then {month(short)} || ' ' || {part(short, 1)} "
            f"when regexp_matches({t}, '{compact}') then {month(compact)} || ' ' || {part(compact, 1)} "
            f"else {t} end)")


def clean_sentence(x: str) -> str:
    text = strip_tags(x)
    for pattern, repl in vocab.CLEANUPS:
        text = f"regexp_replace({text}, {q(pattern)}, {q(repl)}, 'gi')"
    text = squeeze(text)
    return (f"(select case when cs = '' then cs when not regexp_matches(cs, '[.!?]$') then cs || '.' "
            f"when cs like '%..' then left(cs, length(cs) - 1) else cs end from (select {text} as cs))")


def pick(parts: str, n: int) -> str:
    """0-based draw of n from the md5 of a key text."""
    return f"(('0x' || substr(md5({parts}), 1, 8))::BIGINT % {n})"
