"""Documents cut into their sentences as a whole, by the openings of a bank's wordings.

A text is split at sentence boundaries; a piece that opens with a wording is a candidate. What stands
between two chosen candidates is one sentence, so a value may hold periods, line breaks or anything else that
does not open as a known sentence. Where openings are left over or repeat, the cheapest consistent
sequence is found by a fold over the candidates: leaving one unused costs 1, stepping back in the bank's order or
using a slot twice costs 2. Everything is an array expression of one row; nothing is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlake import vocab
from textlake.functions.text import let
from textlake.operators.bank import Bank, Template, cut_wording, normalize_pattern

#: Words that a period does not end a sentence after, and single letters.
_SHORT = r"(?i)(?:^|[\s(])(?:\p{L}|dr|mr|mrs|ms|prof|st|jr|sr|inc|ltd|co|corp|bros|no|vs|dept|ave|rev|gen|col|capt|mt|ft)\.$"
_SPACES = " \n\r\t"
_CUT = r"(?<=[.!?,]\s{1,4})(?=\S)|(?<=\n)(?=\S)"


@dataclass(frozen=True)
class Wording:
    """One way to say a slot: the text before its first value, and ``gaps``, the fields with the text after each.

    A whole sentence has no gaps, and its ``after`` is None.
    """

    slot: int
    template: Template | None
    pool: str
    before: str
    gaps: tuple[tuple[str, str], ...] = ()

    @property
    def after(self) -> str | None:
        return self.gaps[-1][1] if self.gaps else None


def wordings(bank: Bank, noise: list[str] = ()) -> list[Wording]:
    """All wordings that open with text, longest opening first; slot -1 is noise."""
    out = [Wording(-1, None, "std", n) for n in noise]
    for slot, t in enumerate(bank):
        for pool in ("std", "counter", "null"):
            for p in map(normalize_pattern, t.pool(pool)):
                before, gaps = cut_wording(p, t.fields)
                if before.strip():
                    out.append(Wording(slot if t.field else -1, t, pool, before, gaps))
    return sorted(out, key=lambda w: (-len(w.before), w.before, bool(w.gaps), -sum(len(text) for _, text in w.gaps), w.slot))


def _varied(w: Wording, text: str) -> bool:
    return bool(w.template) and any(t.lower() in w.template.synonyms for t in re.findall(r"\w+", text))


def _regex(w: Wording, text: str) -> str:
    """Regex of a text whose words may have been varied."""
    def token(t: str) -> str:
        choices = sorted({t.lower(), *w.template.synonyms[t.lower()]}, key=lambda c: (-len(c), c)) if t.lower() in w.template.synonyms else [t]
        quoted = "|".join(re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", c) for c in choices)
        return f"(?i:{quoted})" if t.lower() in w.template.synonyms else quoted
    return "".join(token(t) for t in re.split(r"(\w+)", text))


def _whole(w: Wording, greedy: bool = False) -> tuple[str, list[str]]:
    """Regex of a whole sentence with a group per field, and the fields; a field said again has to read the same."""
    rx, fields = "(?s)^" + _regex(w, w.before[:1].upper() + w.before[1:]), []
    for i, (f, text) in enumerate(w.gaps):
        rx += rf"\{fields.index(f) + 1}" if f in fields else "(.*)" if greedy else "(.*?)"
        rx += _regex(w, text.rstrip() if i == len(w.gaps) - 1 else text)
        fields += [] if f in fields else [f]
    return rx + "$", fields


def _upper_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def _opens(w: Wording, text: Column) -> Column:
    """Whether a piece, its first letter in upper case, opens with the wording."""
    first = w.before[:1].upper() + w.before[1:]
    end = r"(?=\s|$)" if w.after is None else ""
    if _varied(w, w.before):
        return text.rlike("^" + _regex(w, first) + end)
    if w.after is None:
        return F.startswith(text, F.lit(first)) & (F.rtrim(F.translate(F.substring(text, 1, len(first) + 1), "\n\r\t", "   ")) == first)
    return F.startswith(text, F.lit(first))


def _joined(pieces: Column, start: Column, end: Column) -> Column:
    """Text of the pieces from ``start`` up to ``end``, without white space after it."""
    return F.rtrim(F.array_join(F.slice(pieces, start + 1, F.greatest(end - start, F.lit(0))), ""), F.lit(_SPACES))


def _ends(known: list[Wording], text: Column, number: Column) -> Column:
    """Whether a text ends as the numbered wording does; whole sentences end wherever they do."""
    plain = F.array(*[F.lit("" if w.after is None or _varied(w, w.after) else w.after.rstrip()) for w in known])
    ok = F.endswith(text, F.element_at(plain, number + 1))
    for i, w in enumerate(known):
        same = [v for v in known if v.before == w.before and v.slot == w.slot and v.after is not None]
        if w.after is not None and (_varied(w, w.after) or len({v.after for v in same}) > 1):
            ok = F.when(number == i, reduce(lambda a, b: a | b, [text.rlike(_regex(v, v.after.rstrip()) + "$") for v in same])).otherwise(ok)
    return ok


def segments(contents: Column, known: list[Wording], strict: bool = True) -> Column:
    """``pieces`` of a text, ``chosen`` candidates (place ``i``, wording ``w``, slot ``s``, ``start``), and whether several
    sequences are equally cheap (``ambiguous``). ``strict``: a sentence has to end where the next one starts."""
    pieces = F.split(contents, _CUT, -1)
    deep = 1 + max((len(re.findall(r"[.!?,]\s+(?=\S)|\n(?=\S)", w.before)) for w in known), default=0)
    slot_of, transitions = F.array(*[F.lit(w.slot) for w in known]), [F.lit(t) for t in vocab.TRANSITIONS]

    def candidate(p: Column, x: Column, i: Column) -> Column:
        opening = _upper_first(x if deep == 1 else F.array_join(F.slice(p, i + 1, F.lit(deep)), ""))
        number = let(opening, lambda text: F.coalesce(*[F.when(_opens(w, text), F.lit(k)) for k, w in enumerate(known)]))
        start = F.when((i > 0) & F.trim(F.get(p, i - 1)).isin(transitions), i - 1).otherwise(i)
        return let(number, lambda n: F.struct(i.alias("i"), n.alias("w"), F.get(slot_of, n).alias("s"), start.alias("start")))

    def cheapest(ways: Column, k: Column) -> Column:
        def among(cheap: Column) -> Column:
            count = F.aggregate(cheap, F.lit(0).cast("bigint"), lambda t, x: t + x["ways"])
            return let(F.get(cheap, F.lit(0)), lambda first: F.struct(k.alias("k"), first["cost"].alias("cost"), count.alias("ways"), first["path"].alias("path")))
        return let(ways, lambda w: let(F.array_min(F.transform(w, lambda x: x["cost"])), lambda least: let(F.filter(w, lambda x: x["cost"] == least), among)))

    def sequence(c: Column, bare: Column) -> Column:
        """``bare``: the pieces without white space after them."""
        n, size = F.size(c), F.size(bare)

        def fits(a: Column, b_start: Column) -> Column:
            return b_start > a["i"] if not strict else (b_start > a["i"]) & _ends(known, F.get(bare, b_start - 1), a["w"])

        def step(states: Column, j: Column) -> Column:
            def to(b: Column) -> Column:
                def arrive(s: Column) -> Column:
                    back = (b["s"] >= 0) & F.exists(s["path"], lambda q: F.get(c, q)["s"] >= b["s"])
                    cost = s["cost"] + (j - s["k"] - 1) + F.when(back, 2).otherwise(0)
                    return F.when(fits(F.get(c, s["k"]), b["start"]), F.struct(cost.alias("cost"), s["ways"].alias("ways"), F.concat(s["path"], F.array(j)).alias("path")))
                begin = F.array(F.struct(j.alias("cost"), F.lit(1).cast("bigint").alias("ways"), F.array(j).alias("path")))
                return F.concat(states, F.array(cheapest(F.concat(begin, F.array_compact(F.transform(states, arrive))), j)))
            return let(F.get(c, j), to)

        def finish(states: Column) -> Column:
            ended = F.transform(states, lambda s: F.struct((s["cost"] + n - 1 - s["k"] + F.when(fits(F.get(c, s["k"]), size), 0).otherwise(1000)).alias("cost"),
                                                           s["ways"].alias("ways"), s["path"].alias("path")))
            return let(cheapest(ended, F.lit(0)), lambda best: F.struct(F.transform(best["path"], lambda q: F.get(c, q)).alias("chosen"), (best["ways"] > 1).alias("ambiguous")))
        nothing = F.expr("cast(array() as array<struct<k:int,cost:int,ways:bigint,path:array<int>>>)")
        slots = F.transform(F.filter(c, lambda x: x["s"] >= 0), lambda x: x["s"])
        once = let(slots, lambda s: F.size(F.array_distinct(s)) == F.size(s))
        linked = F.forall(F.sequence(F.lit(0), n - 1), lambda j: fits(F.get(c, j), F.coalesce(F.get(c, j + 1)["start"], size)))
        return (F.when((n == 0) | (once & linked), F.struct(c.alias("chosen"), F.lit(False).alias("ambiguous")))
                .otherwise(F.aggregate(F.sequence(F.lit(0), n - 1), nothing, step, finish)))

    def of(p: Column) -> Column:
        found = F.filter(F.transform(p, lambda x, i: candidate(p, x, i)), lambda x: x["w"].isNotNull())
        bare = F.transform(p, lambda x: F.rtrim(x, F.lit(_SPACES)))
        return let(found, lambda c: let(bare, lambda b: F.struct(p.alias("pieces"), sequence(c, b).alias("found"))))
    return let(pieces, of)


def value_of(seg: Column, t: Template, slot: int, known: list[Wording], binary: tuple[str, ...], strict: bool = True,
             field: str | None = None, greedy: bool = False) -> Column:
    """Text of the value of a slot's field (its first one unless named) in segments; NULL when the slot is not there or
    says that it is missing.

    Where the text between two values stands more than once, the earlier value is the shortest, with ``greedy`` the longest.
    Unless ``strict``, unknown sentences may follow: the sentence is over at the first place where its wording ends,
    a capital letter comes next and no abbreviation stands before.
    """
    chosen, pieces = seg["found"]["chosen"], seg["pieces"]
    own = field in (None, t.field)
    field = field or t.field
    said = {"null": None, "counter": "0" if own and t.klass in binary else None, "std": "1" if own else None}
    groups: dict[str, list[int]] = {}
    for number, w in enumerate(known):
        if w.slot == slot and w.after is not None:
            groups.setdefault(w.before, []).append(number)

    def read(here: Column, text: Column) -> Column:
        chain = F.when(here.isNull(), F.lit(None).cast("string"))
        for number, w in enumerate(known):
            if w.slot == slot and w.after is None:
                chain = chain.when(here["w"] == number, F.lit(said[w.pool]).cast("string"))
        for before, numbers in groups.items():
            inner = F.when(F.lit(False), F.lit(""))
            for w in (known[i] for i in numbers):
                after = w.after.rstrip()
                if len(w.gaps) > 1 or w.gaps[0][0] != field or _varied(w, w.before) or _varied(w, after):
                    rx, shown = _whole(w, greedy)
                    value = F.regexp_extract(_upper_first(text), rx, shown.index(field) + 1) if field in shown else F.lit(said[w.pool]).cast("string")
                    inner = inner.when(_upper_first(text).rlike(rx), value)
                else:
                    inner = inner.when(F.endswith(text, F.lit(after)), F.substring(text, F.lit(len(before) + 1), F.length(text) - len(before) - len(after)))
            chain = chain.when(here["w"].isin(numbers), inner)
        return F.nullif(chain, F.lit(""))

    def at(k: Column) -> Column:
        here, end = F.get(chosen, k - 1), F.coalesce(F.get(chosen, k)["start"], F.size(pieces))
        if not strict:
            def over(m: Column) -> Column:
                bare = F.rtrim(F.get(pieces, m - 1), F.lit(_SPACES))
                return _ends(known, bare, here["w"]) & F.get(pieces, m).rlike(r"^\p{Lu}") & ~bare.rlike(_SHORT)
            end = F.coalesce(F.get(F.filter(F.sequence(here["i"] + 1, F.greatest(end - 1, here["i"] + 1)), over), F.lit(0)), end)
        return let(F.struct(here.alias("here"), _joined(pieces, here["i"], end).alias("text")), lambda x: read(x["here"], x["text"]))
    place = F.array_position(F.transform(chosen, lambda x: x["s"]), F.lit(slot)).cast("int")
    return let(F.nullif(place, F.lit(0)), at)
