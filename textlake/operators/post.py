"""Post-operators on branch results; ``v0`` and ``v1`` are columns of one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlake.sources.readers import value_text
from pyspark.sql import types as T


def number_text(c: Column) -> Column:
    """Plain text of a double, as the answers are written."""
    return value_text(c, T.DoubleType())


def total(count: Column) -> Column:
    return count.cast("string")


def ratio(v0: Column, v1: Column) -> Column:
    """``v0 / v1`` as text, ``None`` for a zero divisor."""
    return F.when(v1 == 0, "None").otherwise(F.concat(number_text(v0), F.lit(" / "), number_text(v1)))


def ratio_value(v0: Column, v1: Column) -> Column:
    return F.try_divide(v0.cast("double"), v1.cast("double"))


def difference(v0: Column, v1: Column) -> Column:
    return v0 - v1


def _yes_no(test: Column) -> Column:
    return F.when(test, "True").otherwise("False")


def greater(v0: Column, v1: Column) -> Column:
    return _yes_no(v0 > v1)


def less(v0: Column, v1: Column) -> Column:
    return _yes_no(v0 < v1)


def has_documents(count: Column) -> Column:
    return _yes_no(count > 0)


def percent(v0: Column, v1: Column) -> Column:
    """``v0 / v1 * 100``; NULL only for a zero divisor."""
    return F.try_divide(v0.cast("double"), v1.cast("double")) * 100


def percent_nonzero(v0: Column, v1: Column) -> Column:
    """As ``percent``, NULL when either side is 0."""
    return F.when((v0 != 0) & (v1 != 0), percent(v0, v1))


def percent_of_count(matching: Column, rows: Column) -> Column:
    """Share of the rows that satisfied the condition; the rows are those after the last join."""
    return percent_nonzero(matching, rows)


def percent_of_sum(part: Column, whole: Column) -> Column:
    return percent_nonzero(part, whole)


def total_percent(filtered: Column, rows: Column) -> Column:
    return percent(filtered, rows)


OPERATORS = {
    "ratio": ratio, "-": lambda a, b: number_text(difference(a, b)), ">": greater, "<": less,
    "percent": lambda a, b: _percent_text(percent(a, b)), "percent forward": lambda a, b: _percent_text(percent(a, b)),
    "percent reverse": lambda a, b: _percent_text(percent_nonzero(a, b)),
    "percent count": lambda a, b: _percent_text(percent_nonzero(a, b)),
    "percent sum": lambda a, b: _percent_text(percent_nonzero(a, b)),
    "total percent": lambda a, b: _percent_text(percent(a, b)),
    "total": lambda a, b: total(a), "bool": lambda a, b: has_documents(a),
}


def _percent_text(c: Column) -> Column:
    return F.coalesce(number_text(c), F.lit("None"))


def apply_list(operators: str, v0: Column, v1: Column) -> Column:
    """Answers of a comma list of operators, in order; unknown names give nothing."""
    names = [n.strip() for n in operators.split(",")]
    return F.array(*[OPERATORS[n](v0, v1) for n in names if n in OPERATORS])


def fallback_value(answers: Column, aggregate: Column, extraction: Column, failed: Column) -> Column:
    """Answers, else the first aggregate, else the first extraction, else ``None`` when the run failed or was empty."""
    spare = F.coalesce(aggregate.cast("string"), extraction.cast("string"), F.when(failed, "None"))
    return F.when(F.size(answers) > 0, answers).otherwise(F.array_compact(F.array(spare)))


def choose_post_op(question: Column, n_branches: Column, has_sum: Column, has_count: Column) -> Column:
    """Post-operator of a question from its wording and branch shape, first rule that holds."""
    q = F.lower(question)

    def says(*words: str) -> Column:
        return reduce(lambda a, b: a | b, [q.contains(w) for w in words])

    two = n_branches >= 2
    return (F.when(says("percent") & has_sum & two, "percent sum")
            .when(says("percent") & two, "percent")
            .when(says("percent") & has_count, "percent count")
            .when(says("ratio") & two, "ratio")
            .when(says("difference", "how many more", "how much more") & two, "-")
            .when(says("more than", "higher than", "greater than") & two, ">")
            .when(says("less than", "lower than", "fewer than") & two, "<")
            .when(q.rlike(r"^(?:is|are|was|were|does|do|did|has|have)\b"), "bool")
            .when(says("how many", "number of") & ~has_count, "total")
            .otherwise(F.lit(None).cast("string")))
