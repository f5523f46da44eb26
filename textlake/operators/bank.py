"""Sentence banks: per field, wordings for present, negative and missing values.

A bank is as large as a table's column list, never as its rows, so it lives on the
driver as plain Python and enters plans as literals.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field as dc_field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POOLS = ("std", "counter", "null")
MAX_BANK_ROWS = 100_000


@dataclass(frozen=True)
class Template:
    """Wordings of one sentence slot; ``field`` is None for a static (noise) slot.

    ``others`` are further fields that its wordings show, in order. Class and pools go by ``field``.
    """

    field: str | None
    std: tuple[str, ...]
    counter: tuple[str, ...] = ()
    null: tuple[str, ...] = ()
    synonyms: dict[str, tuple[str, ...]] = dc_field(default_factory=dict)
    variation_class: str | None = None
    others: tuple[str, ...] = ()

    @property
    def fields(self) -> tuple[str, ...]:
        return ((self.field,) if self.field else ()) + self.others

    @property
    def klass(self) -> str:
        return self.variation_class or infer_class(self.std, self.counter, self.null)

    def pool(self, name: str) -> tuple[str, ...]:
        return {"std": self.std, "counter": self.counter, "null": self.null}[name]


Bank = list[Template]


def infer_class(std, counter, null) -> str:
    """Class of a bank entry from the pools it has."""
    if std and counter and null:
        return "NULLABLE_BINARY"
    if std and counter:
        return "NULL" if any("null" in c.lower() for c in counter) else "BINARY"
    return "STANDARD"


def variation_class(bank: DataFrame, keys: list[str]) -> DataFrame:
    """As ``infer_class`` for bank rows held in a table."""
    def has(pool: str) -> Column:
        return F.bool_or(F.col("pool") == pool)
    flags = bank.groupBy(*keys).agg(
        has("std").alias("s"), has("counter").alias("c"), has("null").alias("n"),
        F.coalesce(F.bool_or((F.col("pool") == "counter") & F.lower("pattern").contains("null")), F.lit(False)).alias("cn"))
    return flags.select(*keys, F.when(F.col("s") & F.col("c") & F.col("n"), "NULLABLE_BINARY")
                        .when(F.col("s") & F.col("c") & F.col("cn"), "NULL")
                        .when(F.col("s") & F.col("c"), "BINARY").otherwise("STANDARD").alias("variation_class"))


def placeholder(name: str) -> str:
    return f"[{name.upper()}]"


def normalize_pattern(pattern: str) -> str:
    """Placeholders in upper case with spaces, either spelling accepted on input."""
    return re.sub(r"\[([^\]]+)\]", lambda m: f"[{m.group(1).upper()}]", pattern)


def cut_wording(pattern: str, fields: tuple[str, ...]) -> tuple[str, tuple[tuple[str, str], ...]]:
    """Text before the first mark of the fields, and for every mark its field and the text up to the next one."""
    marks = {placeholder(f): f for f in fields}
    if not marks:
        return pattern, ()
    parts = re.split("(" + "|".join(re.escape(m) for m in sorted(marks, key=len, reverse=True)) + ")", pattern)
    return parts[0], tuple((marks[m], text) for m, text in zip(parts[1::2], parts[2::2]))


BANK_ROWS = ("pos int, field string, others array<string>, variation_class string, synonyms map<string,array<string>>, "
             "pool string, vid int, pattern string")


def bank_rows(bank: Bank) -> list[tuple]:
    """A row of ``BANK_ROWS`` for every wording; a slot without wordings has one with a NULL pattern."""
    out = []
    for pos, t in enumerate(bank):
        words = [(pool, vid, p) for pool in POOLS for vid, p in enumerate(t.pool(pool))] or [("std", 0, None)]
        synonyms = {w: list(s) for w, s in t.synonyms.items()}
        out += [(pos, t.field, list(t.others), t.variation_class, synonyms, *w) for w in words]
    return out


def bank_to_df(spark: SparkSession, bank: Bank) -> DataFrame:
    return spark.createDataFrame(bank_rows(bank), BANK_ROWS)


def bank_from_df(rows: DataFrame, max_rows: int = MAX_BANK_ROWS) -> Bank:
    """Bank of one table from its rows, as ``bank_to_df`` or ``read_bank`` gives them.

    Only field, pool, vid and pattern have to be there. More than ``max_rows`` wordings are refused before they are collected.
    """
    rows = rows.withColumnsRenamed({"tmpl_ix": "pos", "lexical_sets": "synonyms"})
    wanted = [c for c in ("pos", "field", "others", "variation_class", "synonyms", "pool", "vid", "pattern") if c in rows.columns]
    if "is_static" in rows.columns:
        rows = rows.withColumn("field", F.when(~F.col("is_static"), F.col("field")))
    head = [r.asDict() for r in rows.select(*wanted).limit(max_rows + 1).collect()]
    if len(head) > max_rows:
        raise ValueError(f"a bank has at most {max_rows} wordings; keep larger ones as tables")
    slots: dict[int, dict] = {}
    for r in sorted(head, key=lambda r: (r["pos"], r["pool"], r["vid"])):
        slot = slots.setdefault(r["pos"], {**r, "std": [], "counter": [], "null": []})
        if r["pattern"] is not None:
            slot[r["pool"]].append(r["pattern"])
    return [Template(s["field"], *(tuple(s[p]) for p in POOLS), {w: tuple(v) for w, v in (s.get("synonyms") or {}).items()},
                     s.get("variation_class"), tuple(s.get("others") or ()))
            for _, s in sorted(slots.items())]
