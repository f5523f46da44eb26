"""Checks of sentences, narratives and banks."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import text as X
from textlake.operators.detect import has_name, has_strict
from textlake.operators.model import RowModel, model_map
from textlake.operators.render import extract_tags
from textlake.session import by_shuffle, stored


def missing_tags(narrative: Column, tags: Column) -> Column:
    """Expected tags a narrative lacks."""
    return F.array_except(tags, extract_tags(narrative))


def delimiters_ok(narrative: Column) -> Column:
    n = F.regexp_count(narrative, F.lit(r"\|"))
    return (n > 0) & (n % 2 == 0)


def segments(narrative: Column) -> Column:
    """Texts between pairs of pipes."""
    return F.regexp_extract_all(narrative, F.lit(r"\|\s*([^|]+?)\s*\|"), F.lit(1))


def segment_counts(narrative: Column) -> Column:
    """``(total, tagged)`` segments."""
    found = segments(narrative)
    return F.struct(F.size(found).alias("total"),
                    F.size(F.filter(found, lambda s: s.contains("(Hash:"))).alias("tagged"))


def noise_count_error(narrative: Column, expected_tags: Column, expected_noise: Column) -> Column:
    """Empty text when tagged and untagged segments are as expected, else the reason."""
    c = segment_counts(narrative)
    noise = c["total"] - c["tagged"]
    return (F.when(c["tagged"] != expected_tags, F.concat(
        F.lit("hash count mismatch: expected "), expected_tags.cast("string"), F.lit(", got "), c["tagged"].cast("string")))
            .when((expected_noise > 0) & (noise != expected_noise), F.concat(
                F.lit("transition count mismatch: expected "), expected_noise.cast("string"), F.lit(", got "),
                noise.cast("string"))).otherwise(""))


def smoothing_error(before: Column, after: Column, expected_tags: Column) -> Column:
    """Empty text when a rewritten narrative kept tags and segments, else what changed."""
    ta, tb = F.array_distinct(extract_tags(before)), F.array_distinct(extract_tags(after))
    ca, cb = segment_counts(before), segment_counts(after)
    return (F.when(F.array_sort(ta) != F.array_sort(tb), "tags changed")
            .when(expected_tags != F.size(tb), "tag count")
            .when(ca["total"] != cb["total"], "sentence count changed")
            .when(ca["tagged"] != cb["tagged"], "tagged sentence count changed").otherwise(""))


def needs_backfill(sentences: Column, narrative: Column, has_bank: Column) -> Column:
    """No bank yet, and a sentence lacks its tag, or the narrative lacks tags or is badly delimited."""
    untagged = F.exists(sentences, lambda s: ~s.contains("(Hash:") & (F.trim(s) != "TBD"))
    tags = F.filter(F.transform(sentences, lambda s: F.regexp_extract(s, r"\(Hash:\s*([a-f0-9]+)\)", 1)), lambda t: t != "")
    bad = F.coalesce((F.size(missing_tags(narrative, tags)) > 0) | ~delimiters_ok(narrative), F.lit(False))
    return ~has_bank & (untagged | bad)


def placeholder_gaps(bank: DataFrame, keys: list[str]) -> DataFrame:
    """Standard wordings that lack their own mark, counted per slot.

    ``bank``: (…keys, field, pool, is_static, variation_class, pattern).
    """
    own = F.concat(F.lit("["), F.lower("field"), F.lit("]"))
    std = bank.where((F.col("pool") == "std") & ~F.col("is_static") & F.col("variation_class").isin("STANDARD", "NULL"))
    missing = ~F.contains(F.lower("pattern"), own)
    return (std.groupBy(*keys, "field").agg(F.count("*").alias("n_total"), F.count_if(missing).alias("n_missing"))
            .where("n_missing > 0"))


#: Buckets of words by hash, whose counts are collected to order words by how common they are.
WORD_BUCKETS = 65_536


def _commonness(words: DataFrame) -> Callable[[Column], Column]:
    """How common a word is, as one byte: the logarithm of the count of its bucket. At most ``WORD_BUCKETS`` counts are collected."""
    def bucket(w: Column) -> Column:
        return F.pmod(F.xxhash64(w), F.lit(WORD_BUCKETS))
    levels = bytearray(WORD_BUCKETS)
    counts = words.select(F.explode("words").alias("w")).groupBy(bucket(F.col("w")).alias("b")).agg(F.count("*").alias("n"))
    for r in counts.collect():
        levels[r["b"]] = r["n"].bit_length()
    return lambda w: F.substring(F.lit(levels), bucket(w).cast("int") + 1, F.lit(1))


def similar_texts(a: DataFrame, b: DataFrame, key_a: str, key_b: str, text: str = "text", threshold: float = 0.55,
                  within: list[str] | None = None, dense: bool = False) -> DataFrame:
    """Exact pairs whose word sets have a Jaccard similarity of at least ``threshold``; both sides may be large.

    Texts with the same word set are compared once and get their results by a join, so copies cost no pairs of
    their own. Pairs come from a prefix filter: with words in one order, those rare in ``b`` first, two sets that
    similar share a word among the first ``n - ceil(t * n) + 1`` of each, and at the first such word enough words are
    left in both. Only (set, size, word, place) meets; the words of a set are fetched once per pair.
    Words that ``b`` lacks are only counted, and a set with fewer than ``ceil(t * n)`` others is left out; what is left of
    each side is made once and stored, as making words costs more than all that follows.
    ``within`` limits pairs to equal values of those columns.
    ``dense`` is for sides whose texts have many partners each: pairs of sets of at most ``MAX_PARTS`` parts are listed where
    both meet and never travel; only pairs with a larger set come from the prefix filter. The rows are the same.
    """
    within = within or []

    def word_sets(df: DataFrame, key: str) -> DataFrame:
        return df.select(*within, F.col(key), X.word_set(F.col(text)).alias("words"))

    a, b = word_sets(a, key_a), word_sets(b, key_b)
    if not dense:
        return _rare_pairs(a, b, key_a, key_b, threshold, within)
    a, b = (stored(d, "words").where(F.size("words") > 0) for d in (a, b))
    longest, n = _longest(threshold), F.size("words")
    short = _dense_pairs(a.where(n <= longest), b.where(n <= longest), key_a, key_b, threshold, within, longest)
    if all(d.where(n > longest).isEmpty() for d in (a, b)):
        return short
    long = [d.where(n >= _least_partner(threshold, longest)).select(*within, F.struct(F.col(key).alias("key"), n.alias("n")).alias(side), "words")
            for d, key, side in ((a, key_a, "a"), (b, key_b, "b"))]
    met = _rare_pairs(*long, "a", "b", threshold, within).where(F.greatest("a.n", "b.n") > longest)
    return short.unionByName(met.select(*within, F.col("a.key").alias(key_a), F.col("b.key").alias(key_b), "similarity"))


def _rare_pairs(a: DataFrame, b: DataFrame, key_a: str, key_b: str, threshold: float, within: list[str]) -> DataFrame:
    """``similar_texts`` of word sets by the prefix filter."""
    def least(n: Column) -> Column:
        return F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int")

    common_in_b = _commonness(b)

    def sets(df: DataFrame, key: str) -> DataFrame:
        def known(words: Column) -> Column:
            levels = F.transform(words, lambda w: F.struct(common_in_b(w).alias("l"), w.alias("w")))
            return F.struct(F.size(words).alias("n"), F.filter(levels, lambda x: x["l"] > F.lit(b"\0")).alias("known"))

        # in one generator: a filter on the set would be pushed below it and make every set twice
        fit = F.filter(F.transform(F.array("words"), known), lambda x: F.size(x["known"]) >= F.greatest(least(x["n"]), F.lit(1)))
        return (df.select(*within, key, F.inline(fit))
                .withColumn("words", F.transform(F.array_sort("known"), lambda x: x["w"])).drop("known")
                .withColumn("sid", F.unhex(F.sha2(F.concat_ws(" ", F.col("n").cast("string"), F.array_join("words", " ")), 256))))

    def distinct_sets(s: DataFrame, side: str) -> DataFrame:
        return s.groupBy(*within, F.col("sid").alias(f"sid_{side}")).agg(F.first("words").alias(f"words_{side}"), F.first("n").alias(f"n{side}"))

    def postings(d: DataFrame, side: str) -> DataFrame:
        words, n = F.col(f"words_{side}"), F.col(f"n{side}")
        # ``left``: the words from this place on
        return (d.select(*within, f"sid_{side}", n, F.size(words).alias("k"), F.posexplode(F.slice(words, F.lit(1), F.size(words) - least(n) + 1)).alias("p", "w"))
                .withColumn(f"left_{side}", F.col("k") - F.col("p")).drop("k", "p"))

    # sets kept apart by many keys are as many as the rows, on both sides
    side = by_shuffle if within else lambda d: d
    sa, sb = stored(sets(a, key_a), "sets"), stored(sets(b, key_b), "sets")
    da, db = distinct_sets(sa, "a"), distinct_sets(sb, "b")
    na, nb, needed = F.col("na"), F.col("nb"), F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-9
    met = (postings(da, "a").join(side(postings(db, "b")), [*within, "w"])
           .where((na >= threshold * nb - 1e-9) & (nb >= threshold * na - 1e-9) & (F.least("left_a", "left_b") >= needed))
           .select(*within, "sid_a", "sid_b").distinct())
    common = F.size(F.array_intersect("words_a", "words_b"))
    hits = (met.join(side(db), [*within, "sid_b"]).join(side(da), [*within, "sid_a"]).withColumn("common", common)
            .withColumn("similarity", F.col("common") / (na + nb - F.col("common")))
            .where(F.col("similarity") >= threshold).select(*within, "sid_a", "sid_b", "similarity"))
    ids_a = sa.select(*within, F.col(key_a), F.col("sid").alias("sid_a"))
    ids_b = sb.select(*within, F.col(key_b), F.col("sid").alias("sid_b"))
    return (hits.join(side(ids_b), [*within, "sid_b"]).join(side(ids_a), [*within, "sid_a"])
            .select(*within, key_a, key_b, "similarity"))


#: Parts of one word set that texts may be listed or counted by; larger sets are compared in pairs.
MAX_PARTS = 128

#: Pairs that one task should list of one part; a part with more is dealt to a grid of tasks.
TASK_PAIRS = 1 << 26


def _longest(threshold: float) -> int:
    """Words of the longest sets that have at most ``MAX_PARTS`` parts, 40 at most."""
    longest = 0
    while sum(math.comb(longest + 1, j) for j in range(int((longest + 1) * (1 - threshold) + 1e-9) + 1)) <= MAX_PARTS and longest < 40:
        longest += 1
    return longest


def _least_partner(threshold: float, longest: int) -> int:
    """Words that a set similar to one of more than ``longest`` words must have."""
    return min(k for m in range(1, longest + 2) if (k := _least_common(longest + 1, m, threshold)) <= m)


def _in_every(sets: DataFrame) -> list[str]:
    """The words that every set has."""
    one = sets.select("words").first()
    if one is None:
        return []
    held = sets.select(*[F.every(F.array_contains("words", w)) for w in one["words"]]).first()
    return [w for w, every in zip(one["words"], held) if every]


def _dense_pairs(a: DataFrame, b: DataFrame, key_a: str, key_b: str, threshold: float, within: list[str], longest: int) -> DataFrame:
    """``similar_texts`` of word sets of at most ``longest`` words, each pair listed where the parts of both that are just their
    common words meet.

    A part is a set without up to ``n - ceil(t * n)`` of its words, named by the exclusive or of 64 and 32 bits a word. Two
    sets may share several parts, but what both have lost is without a common word at one only, and there the similarity is
    known. So no pair is met twice, checked by its words or sent on. Words that every set of the other side has are never lost.
    """
    lose = [n - next((k for k in range(1, n + 1) if k / n >= threshold), n) for n in range(longest + 1)]

    def parts(sets: DataFrame, other: DataFrame, side: str) -> DataFrame:
        every = _in_every(other)

        def hashed(words: Column) -> Column:
            return F.transform(words, lambda w: F.struct(F.xxhash64(w).alias("_h"), F.hash(w).alias("_g")))

        def without(x: Column, i: Column) -> Column:
            w = F.element_at("_may", i)
            bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(w["_h"], F.lit(64)).cast("int"))
            return F.struct(x["_h"].bitwiseXOR(w["_h"]).alias("_h"), x["_g"].bitwiseXOR(w["_g"]).alias("_g"), F.concat(x["_lost"], F.array(w["_h"])).alias("_lost"),
                            x["_bits"].bitwiseOR(bit).alias("_bits"), (i + 1).alias("_next"))

        def fewer(level: Column) -> Column:
            return F.flatten(F.transform(level, lambda x: F.transform(F.when(x["_next"] <= F.size("_may"), F.sequence(x["_next"], F.size("_may"))).otherwise(
                F.array().cast("array<int>")), lambda i: without(x, i))))
        rows = sets.select(*within, F.col(key_a if side == "a" else key_b), F.size("words").alias("_n"), hashed(F.col("words")).alias("_all"),
                           hashed(F.filter("words", lambda w: ~w.isin(every)) if every else F.col("words")).alias("_may"))
        whole = F.aggregate("_all", F.struct(F.lit(0).cast("bigint").alias("_h"), F.lit(0).alias("_g")), lambda s, w: F.struct(
            s["_h"].bitwiseXOR(w["_h"]).alias("_h"), s["_g"].bitwiseXOR(w["_g"]).alias("_g")),
            lambda s: F.struct(s["_h"].alias("_h"), s["_g"].alias("_g"), F.array().cast("array<bigint>").alias("_lost"), F.lit(0).cast("bigint").alias("_bits"), F.lit(1).alias("_next")))
        level = F.array(whole)
        levels = [level]
        for lost in range(1, max(lose) + 1):
            level = fewer(level)
            levels.append(F.when(F.element_at(F.lit(lose), F.col("_n") + 1) >= lost, level).otherwise(F.slice(levels[0], 1, 0)))
        return (rows.select(*within, key_a if side == "a" else key_b, "_n", F.inline(F.flatten(F.array(*levels)))).drop("_next")
                .withColumnsRenamed({x: f"{x}_{side}" for x in ("_n", "_lost", "_bits")}))

    pa, pb = parts(a, b, "a"), parts(b, a, "b")
    bucket = F.pmod(F.col("_h"), F.lit(WORD_BUCKETS)).alias("_bucket")
    counts = (pa.select(bucket, F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(pb.select(bucket, F.lit(0).alias("a"), F.lit(1).alias("b")))
              .groupBy("_bucket").agg((F.sum("a") * F.sum("b").cast("double") / F.lit(TASK_PAIRS)).alias("tasks")))
    grids = [(r["_bucket"], math.ceil(math.sqrt(r["tasks"]))) for r in counts.where("tasks > 1").collect()]
    if grids:
        grid = F.broadcast(a.sparkSession.createDataFrame(grids, "_bucket bigint, _grid int"))

        def dealt(p: DataFrame, key: str, own: str, other: str) -> DataFrame:
            g = F.coalesce("_grid", F.lit(1))
            return (p.withColumn("_bucket", bucket).join(grid, "_bucket", "left").withColumn(own, F.pmod(F.xxhash64(key), g).cast("int"))
                    .withColumn(other, F.explode(F.sequence(F.lit(0), g - 1))).drop("_bucket", "_grid"))
        pa, pb = dealt(pa, key_a, "_row", "_column"), dealt(pb, key_b, "_column", "_row")
    common = F.col("_n_a") - F.size("_lost_a")
    return (pa.join(by_shuffle(pb), [*within, "_h", "_g", *(["_row", "_column"] if grids else [])])
            .where((F.col("_bits_a").bitwiseAND(F.col("_bits_b")) == 0) | ~F.arrays_overlap("_lost_a", "_lost_b"))
            .select(*within, key_a, key_b, (common / (F.col("_n_a") + F.col("_n_b") - common)).alias("similarity")).where(F.col("similarity") >= threshold))


def _least_common(n: int, m: int, threshold: float) -> int:
    """Words that sets of n and m words must share to be similar."""
    return next((k for k in range(1, min(n, m) + 1) if k / (n + m - k) >= threshold), min(n, m) + 1)


def _parts(words: Column, threshold: float, longest: int) -> Column:
    """Every part of a word set that a similar set can share: the set without up to ``n - least`` of its words."""
    lose = [max((n - k for m in range(1, longest + 1) if (k := _least_common(n, m, threshold)) <= min(n, m)), default=0) for n in range(longest + 1)]
    may_lose, most = F.element_at(F.lit(lose), F.size(words) + 1), max(lose)

    def without(x: Column, i: Column) -> Column:
        kept = F.concat(F.slice(x["w"], F.lit(1), i - 1), F.slice(x["w"], i + 1, F.size(x["w"])))
        return F.struct(kept.alias("w"), i.alias("next"))

    def fewer(level: Column) -> Column:
        return F.flatten(F.transform(level, lambda x: F.transform(F.when(x["next"] <= F.size(x["w"]), F.sequence(x["next"], F.size(x["w"]))).otherwise(
            F.array().cast("array<int>")), lambda i: without(x, i))))
    level, levels = F.array(F.struct(words.alias("w"), F.lit(1).alias("next"))), []
    for lost in range(most + 1):
        level = fewer(level) if lost else level
        levels.append(F.when(may_lose >= lost, F.transform(level, lambda x: x["w"])).otherwise(F.array().cast("array<array<string>>")))
    return F.flatten(F.array(*levels))


def text_links(a: DataFrame, b: DataFrame, key: str, text: str = "text", threshold: float = 0.55) -> DataFrame:
    """``(side, key, class_id, n_links)`` of every text of two large sides: its class, the smallest key of its side with the
    same word set, and how many texts of the other side have a Jaccard similarity of at least ``threshold``. Exact.

    Links are counted, not listed, so the work does not grow with their number. Two sets that are similar share a part of at
    least ``o`` words, and with k common words they share C(k, j) parts of j words; the sum over j >= o of
    (-1)^(j-o) C(j-1, o-1) C(k, j) is 1 for k >= o and 0 below. So each set adds up counts of its own parts, weighted. Sets with more than
    ``MAX_PARTS`` parts meet in pairs, by ``similar_texts``. A text without words is a class of its own and has no link.
    """
    longest = _longest(threshold)
    words = F.array_sort(X.word_set(F.col(text)))
    rows = reduce(DataFrame.unionByName, [d.select(F.lit(side).alias("side"), F.col(key), words.alias("words")) for side, d in (("a", a), ("b", b))])
    rows = rows.withColumn("sid", F.when(F.size("words") > 0, F.unhex(F.sha2(F.array_join("words", " "), 256))))
    sets = (rows.where("sid is not null").groupBy("side", "sid")
            .agg(F.min(key).alias("class_id"), F.count("*").alias("m"), F.first("words").alias("words")).withColumn("n", F.size("words")))
    sets = stored(sets, "classes")  # read by the parts, the longer sets and the classes
    sizes = range(1, longest + 1)
    weights = F.broadcast(a.sparkSession.createDataFrame(
        [(n, m, j, (-1) ** (j - o) * math.comb(j - 1, o - 1)) for n in sizes for m in sizes for o in [_least_common(n, m, threshold)] for j in range(o, min(n, m) + 1)],
        "n int, n_other int, j int, weight bigint"))
    parts = (sets.where(F.col("n") <= longest).select("side", "sid", "m", "n", F.explode(_parts(F.col("words"), threshold, longest)).alias("w"))
             .select("side", "sid", "m", "n", F.unhex(F.md5(F.array_join("w", " "))).alias("part"), F.size("w").alias("j")))
    held = (parts.groupBy("side", "part", F.col("n").alias("n_other")).agg(F.sum("m").alias("held"))
            .withColumn("side", F.when(F.col("side") == "a", "b").otherwise("a")))
    counted = (parts.join(by_shuffle(held), ["side", "part"]).join(weights, ["n", "n_other", "j"])
               .select("side", "sid", (F.col("weight") * F.col("held")).alias("links")))
    long = sets.where(F.col("n") >= _least_partner(threshold, longest)).select("side", F.struct("sid", "m", "n").alias("set"), F.array_join("words", " ").alias("text"))
    met = similar_texts(long.where("side = 'a'").withColumnRenamed("set", "a"), long.where("side = 'b'").withColumnRenamed("set", "b"), "a", "b",
                        threshold=threshold).where(F.greatest("a.n", "b.n") > longest)
    paired = met.select(F.inline(F.array(F.struct(F.lit("a").alias("side"), F.col("a.sid").alias("sid"), F.col("b.m").alias("links")),
                                         F.struct(F.lit("b").alias("side"), F.col("b.sid").alias("sid"), F.col("a.m").alias("links")))))
    links = counted.unionByName(paired).groupBy("side", "sid").agg(F.sum("links").alias("n_links"))
    classes = sets.select("side", "sid", "class_id").join(by_shuffle(links), ["side", "sid"], "left")
    return rows.join(by_shuffle(classes), ["side", "sid"], "left").select(
        "side", key, F.when(F.col("sid").isNull(), F.col(key)).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def orphan_columns(tag_map: DataFrame, slots: DataFrame, sentences: DataFrame, keys: list[str],
                   threshold: float = 0.55) -> DataFrame:
    """Columns with a tag but no data slot, matched to a slot by exact text, else by similar text.

    ``tag_map``: (…keys, field, tag, is_tbd); ``slots``: (…keys, tmpl_ix, field, is_static,
    original); ``sentences``: (…keys, tag, sentence without tag).
    """
    handled = slots.where(~F.col("is_static")).select(*keys, "field").distinct()
    orphans = tag_map.where(~F.col("is_tbd")).join(by_shuffle(handled), [*keys, "field"], "left_anti")
    src = orphans.join(by_shuffle(sentences), [*keys, "tag"], "left").select(*keys, "field", F.col("sentence").alias("source"))
    exact = src.join(by_shuffle(slots.select(*keys, "tmpl_ix", F.col("original").alias("source"))), [*keys, "source"]).groupBy(
        *keys, "field").agg(F.max("tmpl_ix").alias("exact_ix"))
    loose = src.join(by_shuffle(exact), [*keys, "field"], "left_anti").where("source is not null")
    near = similar_texts(loose.select(*keys, "field", F.col("source").alias("text")),
                         slots.select(*keys, "tmpl_ix", F.col("original").alias("text")), "field", "tmpl_ix",
                         threshold=threshold, within=keys).groupBy(*keys, "field").agg(F.min("tmpl_ix").alias("near_ix"))
    return (orphans.select(*keys, "field").distinct().join(by_shuffle(exact), [*keys, "field"], "left").join(by_shuffle(near), [*keys, "field"], "left")
            .select(*keys, "field", F.coalesce("exact_ix", "near_ix", F.lit(-1)).alias("tmpl_ix"),
                    F.when(F.col("exact_ix").isNotNull(), "exact").when(F.col("near_ix").isNotNull(), "similar")
                    .otherwise("unmatched").alias("matched_by")))


def variation_ok(variation: Column, n_marks: Column | int, values: Column | None = None) -> Column:
    """The right number of marks and no literal value left."""
    ok = X.count_placeholders(variation) == n_marks
    if values is None:
        return ok
    low = F.lower(variation)
    return ok & ~F.exists(values, lambda v: F.contains(low, F.lower(v)) & ~v.isin("not specified", "unspecified"))


def counter_ok(variation: Column, n_marks: Column | int, field: Column) -> Column:
    own = F.concat(F.lit("["), F.upper(field), F.lit("]"))
    return (X.count_placeholders(variation) == n_marks) & ~F.contains(variation, own)


def patch_bank(slots: DataFrame, corrections: DataFrame, insertions: DataFrame, keys: list[str]) -> DataFrame:
    """Bank slots with corrections in place and insertions added.

    ``slots`` and ``corrections``: (…keys, tmpl_ix, field, is_static, original); every
    insertion (…keys, field, original) takes the place of the first static slots, so the
    share of noise stays.
    """
    fixed = slots.join(corrections.select(*keys, "tmpl_ix"), [*keys, "tmpl_ix"], "left_anti").withColumn("_new", F.lit(False))
    patched = fixed.unionByName(corrections.select(*slots.columns).withColumn("_new", F.lit(True)))
    added = insertions.groupBy(*keys).agg(F.count("*").alias("_k"))
    # a bank is one table's wordings: at most a few hundred slots per key
    rank = F.row_number().over(Window.partitionBy(*keys, F.col("is_static") & ~F.col("_new")).orderBy("tmpl_ix"))
    kept = (patched.withColumn("_r", rank).join(added, keys, "left")
            .where(~(F.col("is_static") & ~F.col("_new") & (F.col("_r") <= F.coalesce("_k", F.lit(0))))))
    top = slots.groupBy(*keys).agg(F.max("tmpl_ix").alias("_top"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("field"))
    appended = insertions.join(top, keys, "left").select(
        *keys, (F.coalesce("_top", F.lit(-1)) + place).cast("int").alias("tmpl_ix"), "field", F.lit(False).alias("is_static"),
        "original")
    return kept.select(*slots.columns).unionByName(appended.select(*slots.columns))


def noise_leaks(noise: DataFrame, fields: DataFrame, keys: list[str]) -> DataFrame:
    """Noise sentences that name a field or hold a value (or a longer word of one) of their own row.

    ``noise``: (…keys, nid, sentence); ``fields``: (…keys, field, value).
    """
    j = noise.join(fields, keys)
    tokens = F.filter(F.split("value", r"[\s,\-/]+"), lambda t: F.length(t) > 2)
    partial = (F.length("value") > 3) & F.exists(tokens, lambda t: has_strict(F.col("sentence"), t))
    named, whole = has_name(F.col("sentence"), F.col("field")), has_strict(F.col("sentence"), F.col("value"))
    return (j.select(*keys, "nid", "field", "value", named.alias("name_found"), whole.alias("value_found"),
                     (~whole & partial).alias("partial_found"))
            .where("name_found or value_found or partial_found"))


def well_formed(s: Column) -> Column:
    """At least ten characters, a capital first, sentence punctuation last."""
    t = F.trim(s)
    return F.coalesce((F.length(t) >= 10) & t.rlike(r"^\p{Lu}") & t.rlike(r"[.!?]$"), F.lit(False))


def scrub_noise(noise: DataFrame, fields: DataFrame, keys: list[str], model: RowModel) -> DataFrame:
    """Noise sentences with leaked values rewritten; sentences that still leak or read badly are dropped."""
    leaks = noise_leaks(noise, fields, keys).where("value_found").groupBy(*keys, "nid").agg(F.min("value").alias("leak"))
    marked = noise.join(leaks, [*keys, "nid"], "left")
    prompt = F.when(F.col("leak").isNotNull(), F.concat_ws("\t", F.lit("scrub"), "sentence", "leak"))
    asked = model_map(marked.withColumn("_prompt", prompt), "_prompt", model, "_answer")
    changed = asked.withColumn("sentence", F.coalesce("_answer", "sentence")).drop("_prompt", "_answer")
    still = noise_leaks(changed.select(*keys, "nid", "sentence"), fields, keys).where("value_found or name_found")
    return (changed.join(still.select(*keys, "nid").distinct(), [*keys, "nid"], "left_anti")
            .where(F.col("leak").isNull() | well_formed(F.col("sentence"))).drop("leak"))


def fix_context_bleed(rows: DataFrame, model: RowModel) -> DataFrame:
    """Model rewrite of sentences, taken only when it is different and well formed."""
    asked = model_map(rows.withColumn("_prompt", F.concat_ws("\t", F.lit("scrub"), "sentence", "leak")),
                      "_prompt", model, "_answer")
    take = (F.trim("_answer") != F.trim("sentence")) & well_formed(F.col("_answer"))
    return asked.withColumn("sentence", F.when(take, F.trim("_answer")).otherwise(F.col("sentence"))).drop("_prompt", "_answer")
