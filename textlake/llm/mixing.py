"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm.blocks import free_prefix

DIMENSIONS = ("source", "lang", "topic")
#: Cells (combinations of source, language and topic) that the driver fits and tasks look up; more raise an error.
MAX_CELLS = 200_000


def topic_of(text: Column) -> Column:
    """A rough topic of a text: ``legal``, ``contact``, ``markup`` or ``prose``; null text is ``prose``."""
    low = F.lower(text)
    return (F.when(low.contains("license") | low.contains("copyright"), "legal")
            .when(text.contains("@"), "contact")
            .when(text.rlike(r"[#*%$<>{}]{2}"), "markup").otherwise("prose"))


def words_of(text: Column) -> Column:
    """Number of words between white space, as the token weight of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def tempered(totals: dict, power: float = 0.7) -> dict:
    """Target shares that lean towards equal ones: token shares to a power, normalised."""
    raised = {k: v ** power for k, v in totals.items() if v > 0}
    whole = sum(raised.values())
    return {k: v / whole for k, v in raised.items()}


def rake(keys: list[tuple], tokens: np.ndarray, targets: list[dict], rounds: int = 500, close: float = 1e-10) -> np.ndarray:
    """Token weights of the cells whose marginals are the targets, nearest to the given tokens.

    Each round scales the cells of every value of one dimension to the value's target, dimension after
    dimension, until all marginals agree. Values without a target get none; targets without tokens are shared out
    by the others. The weights sum to the tokens.
    """
    weight = tokens.astype(np.float64)
    total = weight.sum()
    if not total:
        return weight
    groups = []
    for d, target in enumerate(targets):
        values = sorted({k[d] for k in keys}, key=repr)
        index = {v: i for i, v in enumerate(values)}
        group = np.array([index[k[d]] for k in keys])
        has = np.bincount(group, weights=weight, minlength=len(values)) > 0
        goal = np.array([target.get(v, 0.0) for v in values]) * has
        if not goal.sum():
            raise ValueError(f"no target of dimension {d} has tokens")
        groups.append((group, goal / goal.sum() * total))
    for _ in range(rounds):
        off = 0.0
        for group, goal in groups:
            have = np.bincount(group, weights=weight, minlength=len(goal))
            off = max(off, np.abs(have - goal).max())
            weight = weight * np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)[group]
        if off <= close * total:
            break
    return weight


def _factors(group: np.ndarray, goal: np.ndarray, most: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Factor of each group with which the sum of ``most * min(1, factor * chance)`` is its goal (all of it, if the goal is more)."""
    order = np.lexsort((-chance, group))
    g, m, c = group[order], most[order], chance[order]
    first = np.searchsorted(g, np.arange(len(goal)))
    full, part = np.concatenate([[0.0], np.cumsum(m)]), np.concatenate([[0.0], np.cumsum(m * c)])
    end = np.searchsorted(g, np.arange(len(goal)), side="right")
    # cells before this one are taken whole, the others in proportion
    rest, left = part[end][g] - part[:-1], goal[g] - (full[:-1] - full[first][g])
    factor = np.divide(left, rest, out=np.zeros(len(g)), where=rest > 0)
    fits = np.flatnonzero((factor * c <= 1) & (rest > 0))
    out = np.full(len(goal), np.inf)
    at = np.searchsorted(g[fits], np.arange(len(goal)))
    some = at < len(fits)
    some[some] = g[fits[at[some]]] == np.flatnonzero(some)
    out[some] = np.maximum(factor[fits[at[some]]], 0.0)
    # a group that is taken whole: a factor that fills its smallest chance, all the same finite
    least = np.full(len(goal), np.inf)
    np.minimum.at(least, g[c > 0], c[c > 0])
    return np.where(np.isfinite(out), out, np.where(np.isfinite(least), 1 / least, 0.0))


def attainable(goal: np.ndarray, most: np.ndarray, want: float) -> np.ndarray:
    """Goals that sum to ``want`` (to all there is, if less) in proportion, those above what a value has lowered to that."""
    chance = np.divide(goal, most, out=np.zeros(len(goal)), where=most > 0)
    factor = _factors(np.zeros(len(goal), np.int64), np.array([min(want, most.sum())]), most, chance)[0]
    return most * np.minimum(1, factor * chance)


def bounded(keys: list[tuple], tokens: np.ndarray, targets: list[dict], share: float, rounds: int = 2000, close: float = 1e-9) -> np.ndarray:
    """Tokens to keep of each cell, none more than it has, whose marginals are the attainable targets of a share of all tokens.

    Iterative proportional fitting with the bound inside: a cell that is taken whole stays so, the others of its value
    are scaled further. Where dimensions contradict each other the last round stands.
    """
    want, scale, groups = share * tokens.sum(), np.ones(len(tokens)), []
    if not tokens.sum():
        return tokens.astype(np.float64)
    for d, target in enumerate(targets):
        values = sorted({k[d] for k in keys}, key=repr)
        index = {v: i for i, v in enumerate(values)}
        group = np.array([index[k[d]] for k in keys])
        most = np.bincount(group, weights=tokens, minlength=len(values))
        groups.append((group, attainable(np.array([target.get(v, 0.0) for v in values]), most, want)))
    for _ in range(rounds):
        off = 0.0
        for group, goal in groups:
            have = np.bincount(group, weights=tokens * np.minimum(1, scale), minlength=len(goal))
            off = max(off, np.abs(have - goal).max())
            scale = np.minimum(scale * _factors(group, goal, tokens, scale)[group], 1e12)
        if off <= close * tokens.sum():
            break
    return tokens * np.minimum(1, scale)


def probabilities(tokens: np.ndarray, weight: np.ndarray, share: float) -> np.ndarray:
    """min(1, s * weight / tokens) with the s that makes the expected tokens ``share`` of all (all that can be, if less)."""
    ratio = np.divide(weight, tokens, out=np.zeros(len(tokens)), where=tokens > 0)
    want = share * tokens.sum()
    low, high = 0.0, 1.0
    while (tokens * np.minimum(1, high * ratio)).sum() < want and high < 1e18:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (tokens * np.minimum(1, mid * ratio)).sum() < want else (low, mid)
    return np.minimum(1, high * ratio)


#: Columns that ``mix`` adds.
NAMES = ("topic", "tokens", "weight", "probability", "kept")


def mix(docs: DataFrame, share: float = 0.7, targets: dict[str, dict] | None = None, power: float = 0.7, seed: int = 11, prefix: str = "_") -> DataFrame:
    """All columns of ``docs`` with ``_topic, _tokens, _weight, _probability, _kept`` added, or led by another ``prefix``.

    ``targets`` gives the token share of every source, language and topic (by default the corpus's own
    shares to ``power``). ``_weight`` is the raked weight of one token of the document's cell, ``_probability`` its
    calibrated chance (the expected kept tokens meet the targets; one above what a value has is lowered to all it has, and
    the others of its dimension share the rest), ``_kept`` the draw: a hash of doc_id and seed below the chance, so runs agree and
    rows that repeat an id go together. Missing values are values of their own; texts without words weigh nothing and
    are kept with the chance of their cell. Only cells are counted and collected; documents are not shuffled.
    """
    text = F.col("text").cast("string")
    topic, words, weight_of, chance_of, kept = (prefix + n for n in NAMES)
    marked = docs.withColumns({topic: F.coalesce(topic_of(text), F.lit("prose")), words: words_of(text)})
    found = marked.groupBy("source", "lang", F.col(topic).alias("topic")).agg(F.sum(words).alias("tokens")).limit(MAX_CELLS + 1).collect()
    if len(found) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} combinations of source, language and topic; join rare sources first")
    keys = [tuple(r[d] for d in DIMENSIONS) for r in found]
    tokens = np.array([r["tokens"] or 0 for r in found], np.float64)
    totals = [{} for _ in DIMENSIONS]
    for key, n in zip(keys, tokens):
        for d, value in enumerate(key):
            totals[d][value] = totals[d].get(value, 0.0) + n
    goals = [(targets or {}).get(name) or tempered(totals[d], power) for d, name in enumerate(DIMENSIONS)]
    weight = rake(keys, tokens, goals)
    chance = probabilities(tokens, bounded(keys, tokens, goals, share), share)
    rows = [(*[None if v is None else str(v) for v in k], float(w / t) if t else 0.0, float(p) if t else 1.0) for k, w, p, t in zip(keys, weight, chance, tokens)]
    place = free_prefix(marked.columns, "s", "l", "t")
    own = [*(place + n for n in "slt"), weight_of, chance_of]
    cells = docs.sparkSession.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(own, ("string", "string", "string", "double", "double"))))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    on = (F.col("source").cast("string").eqNullSafe(F.col(own[0])) & F.col("lang").cast("string").eqNullSafe(F.col(own[1])) & (F.col(topic) == F.col(own[2])))
    # at most MAX_CELLS short rows, checked above
    return marked.join(F.broadcast(cells), on, "left").drop(*own[:3]).withColumn(kept, draw < F.col(chance_of))
