"""Table function that reads the fields of a document, for SQL users."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from textlake.operators.bank import Bank, cut_wording, normalize_pattern


def _readers(bank: Bank) -> list[tuple[list[str], str]]:
    """``(fields, regex)`` of every wording that shows values, with a group per field."""
    out = []
    for t in bank:
        if t.field is None:
            continue
        for p in map(normalize_pattern, (*t.std, *t.counter, *t.null)):
            before, gaps = cut_wording(p, t.fields)
            if gaps:
                first = f"[{before[0].upper()}{before[0].lower()}]{re.escape(before[1:])}" if before[:1].isalpha() else re.escape(before)
                fields, rest = [], ""
                for f, text in gaps:
                    rest += (f"(?:\\{fields.index(f) + 1})" if f in fields else "(.*?)") + re.escape(text)
                    fields += [] if f in fields else [f]
                out.append((fields, rf"(?s)(?:^|(?<=\n)|(?<=[.!?,]\s)){first}{rest}(?=\s|$)"))
    return out


def register_extract_fields(spark: SparkSession, bank: Bank, name: str = "extract_fields") -> None:
    """Register ``name(contents)`` yielding (field, value) for the wordings of a bank."""
    readers = _readers(bank)

    @udtf(returnType="field string, value string", useArrow=True)
    class ExtractFields:
        def __init__(self):
            self._compiled = [(f, re.compile(p)) for f, p in readers]

        def eval(self, contents: str) -> Iterator[tuple[str, str]]:
            seen = set()
            for fields, rx in self._compiled:
                hit = rx.search(contents or "") if not seen.issuperset(fields) else None
                for field, value in zip(fields, hit.groups() if hit else ()):
                    if field not in seen:
                        seen.add(field)
                        yield field, value

    spark.udtf.register(name, ExtractFields)
