"""Phrase collocations by top-order marginalisation.

Every place of a text gives one window: its word and, in lead columns, the four after it in the same
piece, padded where the piece ends. Only windows are counted; Spark's ROLLUP over the columns then sums
them to the counts of all shorter prefixes, so no phrase length is exploded of its own.

A phrase can only reach ``least`` places if each of its words, adjacent pairs and triples does. These are
therefore screened first, by 40-bit hashes and in parts; a window is padded from its first rare word, pair or
triple on. The screens are bitmaps of a fixed size whatever the input: a rare word that shares a bit with
a frequent one costs work only, since counts of phrases come from the windows alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.blocks import Batches, block, chunks, exchange, gather, mix, narrow_batches, part_keys, release, runs, split, stored, text_bytes
from textlake.llm.words import LOWER, span_hash

LONGEST = 5
#: Runs of up to so many words are screened.
SCREENED = 3
#: log2 of the bits of a screen: 16 MB, a bound that holds for any input.
SCREEN_BITS = 27
#: Hashes a task holds before it counts and sends them.
FLUSH = 1 << 21
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_KEYS = pa.schema([("part", pa.int32()), ("high", pa.binary()), ("low", pa.binary()), ("counts", pa.binary())])
_COLUMNS = [f"w{k}" for k in range(1, LONGEST + 1)]


def _places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word id, piece, language number, start, end) of each word, and the lower-cased bytes.

    A word id is the hash of the word and its language, so equal words of two languages differ.
    """
    data, offsets = text_bytes(batch.column("text"))
    code = LOWER[data]
    gap, edge = _GAP[code], np.zeros(len(code) + 1, bool)
    edge[offsets] = True
    before, after = np.ones(len(code), bool), np.ones(len(code), bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    starts, ends = np.flatnonzero(~gap & (before | edge[:-1])), np.flatnonzero(~gap & (after | edge[1:])) + 1
    piece = np.cumsum(_BREAK[code] | edge[:-1])[starts] if len(code) else starts
    lang = batch.column("lang").dictionary_encode()
    names = [n.encode() for n in lang.dictionary.to_pylist()]
    seeds = np.array([int(span_hash(np.frombuffer(b"\x01" + n, np.uint8), np.array([0]), np.array([len(n) + 1]))[0]) for n in names], np.uint64)
    number = lang.indices.to_numpy()[np.searchsorted(offsets, starts, side="right") - 1]
    ids = mix(span_hash(code, starts, ends) + seeds[number]) if len(starts) else np.zeros(0, np.uint64)
    return np.maximum(ids, np.uint64(1)), piece, number, starts, ends, code


def _joined(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place of ``at``."""
    value = ids[at]
    for k in range(1, n):
        value = mix(value * np.uint64(0x9FB21C651E98DF25) + ids[at + k])
    return value


def _often(ids: np.ndarray, piece: np.ndarray, screens: list[np.ndarray]) -> list[np.ndarray]:
    """For each screen n = 1, 2, ..: whether the n words from each place pass it, as all shorter ones in them do."""
    out = [_has(screens[0], ids)] if screens else []
    for n in range(2, len(screens) + 1):
        at = _next(out[-1], piece, n)
        found = np.zeros(len(ids), bool)
        found[at] = _has(screens[n - 1], _joined(ids, at, n))
        out.append(found)
    return out


def _next(shorter: np.ndarray, piece: np.ndarray, n: int) -> np.ndarray:
    """Places where n words stand in one piece whose first and last n - 1 words pass."""
    end = max(len(piece) - n + 1, 0)
    return np.flatnonzero(shorter[:end] & shorter[1:end + 1] & (piece[n - 1:] == piece[:end])) if end else np.zeros(0, np.int64)


def _bit(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bit of a screen that a 40-bit key has."""
    return (keys >> np.uint64(40 - bits)).astype(np.int64)


def _has(screen: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _bit(hashes >> np.uint64(24), (len(screen) * 8).bit_length() - 1)
    return (screen[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _counted(found: Iterator[np.ndarray], keys: np.ndarray, bits: int) -> Batches:
    """Blocks of (key, count) for the parts that own the keys' bits."""
    held: list[np.ndarray] = []

    def send():
        value, n = np.unique(np.concatenate(held), return_counts=True)
        owner = _bit(value, bits) * len(keys) >> bits
        high, low = (value >> np.uint64(8)).astype(np.uint32), value.astype(np.uint8)
        return block([(int(keys[p]), *columns) for p, columns in split(owner, len(keys), high, low, n.astype(np.uint32))], _KEYS)
    for value in found:
        held.append(value >> np.uint64(24))
        if sum(map(len, held)) >= FLUSH:
            yield send()
            held.clear()
    if held:
        yield send()


def _screen(rows: DataFrame, keys: np.ndarray, least: int, bits: int, hashes) -> np.ndarray:
    """Bitmap of the hashes that the arrays of ``hashes(batches)`` hold at least ``least`` times in all of ``rows``.

    Each part counts the hashes of a range of bits and gives that range back: the driver gets the bitmap,
    16 MB in all, never the hashes.
    """
    def count(batches):
        release()
        yield from _counted(hashes(batches), keys, bits)

    def reduce(batches):
        high, low, n = gather(batches, ("high", np.uint32), ("low", np.uint8), ("counts", np.uint32))
        value = (high.astype(np.uint64) << np.uint64(8)) | low
        order = np.argsort(value)
        value, n = value[order], n[order].astype(np.int64)
        starts = runs(value)[:-1]
        if not len(starts):
            return
        often = _bit(value[starts][np.add.reduceat(n, starts) >= least], bits)
        if len(often):
            first = int(often[0]) >> 3
            own = np.zeros((int(often[-1]) >> 3) - first + 1, np.uint8)
            np.bitwise_or.at(own, (often >> 3) - first, np.left_shift(1, often & 7).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([zlib.compress(own.tobytes(), 1)])], ["first", "bits"])
    sent = rows.mapInArrow(count, "part int, high binary, low binary, counts binary")
    screen = np.zeros(1 << bits - 3, np.uint8)
    for row in exchange(sent, keys, reduce, "first long, bits binary").collect():
        own = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
        screen[row["first"]:row["first"] + len(own)] |= own
    return screen


def _counts(docs: DataFrame, keys: np.ndarray, least: int, bits: int) -> DataFrame:
    """``lang, level, w1..w5, f`` of all prefixes of windows.

    ``level`` is the number of words, 0 for all places of a language; only prefixes with ``f >= least`` are kept.
    """
    spark, screens = docs.sparkSession, []
    for n in range(1, SCREENED + 1):
        before = list(screens)

        def hashes(batches, n=n, before=before):
            for batch in chunks(batches):
                ids, piece, *_ = _places(batch)
                at = _next(_often(ids, piece, [s.value for s in before])[-1], piece, n) if before else np.arange(len(ids))
                yield _joined(ids, at, n)
        screens.append(spark.sparkContext.broadcast(_screen(docs, keys, least, bits, hashes)))

    def windows(batches):
        release()
        for batch in chunks(batches):
            ids, piece, number, *_ = _places(batch)
            if not len(ids):
                continue
            names = batch.column("lang").dictionary_encode().dictionary
            often = _often(ids, piece, [s.value for s in screens])
            lead = np.zeros((LONGEST, len(ids)), np.uint64)
            lead[0], live = np.where(often[0], ids, 0), often[0]
            for k in range(1, LONGEST):
                # the word joins if the longest screened run that ends in it is frequent
                n = min(k + 1, SCREENED)
                live = live[:len(ids) - k] & often[n - 1][k + 1 - n:len(ids) + 1 - n]
                lead[k, :len(ids) - k] = np.where(live, ids[k:], 0)
            whole = number.astype(np.uint64)
            for column in lead:
                whole = mix(whole * np.uint64(0xD6E8FEB86659FD93) + column)
            _, first, n = np.unique(whole, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(number[first])), *[pa.array(c[first].view(np.int64)) for c in lead], pa.array(n)], ["lang", *_COLUMNS, "f"])
    found = docs.mapInArrow(windows, f"lang string, {', '.join(c + ' long' for c in _COLUMNS)}, f long")
    level = sum(F.when(F.grouping(c) == 0, 1).otherwise(0) for c in _COLUMNS)
    rolled = (found.rollup("lang", *_COLUMNS)
              .agg(F.sum("f").alias("f"), level.alias("level"), F.grouping("lang").alias("all")))
    last = F.coalesce(*[F.col(c) for c in reversed(_COLUMNS)], F.lit(1))
    counts = rolled.where((F.col("all") == 0) & (last != 0) & ((F.col("f") >= least) | (F.col("level") == 0))).drop("all")
    return stored(counts, "prefixes")


def _spelled(docs: DataFrame, ids: DataFrame, keys: np.ndarray, bits: int) -> DataFrame:
    """``id, word`` of all words with one of ``ids``, and of some others; a task sends a word about once."""
    def hashes(batches):
        for batch in batches:
            yield batch.column("id").to_numpy().view(np.uint64)
    wanted = docs.sparkSession.sparkContext.broadcast(_screen(ids, keys, 1, bits, hashes))

    def spellings(batches):
        release()
        sent = np.zeros(0, np.uint64)
        for batch in chunks(batches):
            value, _, _, starts, ends, code = _places(batch)
            hit = np.flatnonzero(_has(wanted.value, value))
            fresh, place = np.unique(value[hit], return_index=True)
            new = ~np.isin(fresh, sent)
            place = hit[place[new]]
            sent = np.union1d(sent, fresh[new]) if len(sent) < FLUSH else fresh[new]
            raw = code.tobytes()
            words = [raw[a:b].decode() for a, b in zip(starts[place].tolist(), ends[place].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(fresh[new].view(np.int64)), pa.array(words, pa.string())], ["id", "word"])
    return docs.mapInArrow(spellings, "id long, word string").groupBy("id").agg(F.min("word").alias("word"))


def _leading(rows: DataFrame, spread, order: list, top: int, place) -> DataFrame:
    """Rows whose ``place`` (row_number or rank) by ``order`` is at most ``top`` in their language.

    The first of each bucket hold the first of all, so no task orders all rows of a language.
    """
    inner = Window.partitionBy("lang", F.pmod(F.xxhash64(spread), F.lit(64))).orderBy(*order)
    few = rows.withColumn("_place", place().over(inner)).where(F.col("_place") <= top)
    return few.withColumn("_place", place().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_place") <= top).drop("_place")


def collocations(docs: DataFrame, least: int = 100, top: int | None = 2000, bits: int = SCREEN_BITS) -> DataFrame:
    """Phrases of 2 to 5 words that occur together more often than their parts would by chance, per language.

    Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and into words ``[^\\x20\\x09]+``; null text is
    empty, null lang is ``und``, other columns are not looked at, repeated rows count each time. A candidate has
    ``a = f(phrase) >= least``; its score is the least floor(1000 a n / (l r)) over its cuts, ties to the shortest
    first part. A candidate within a longer one that is as frequent is dropped. ``lang, rank, phrase, a, l, r, n, score``,
    the first ``top`` (None: all) of each language by score, a (both descending) and phrase (bytes ascending); no rows
    for an empty table.
    """
    spark = docs.sparkSession
    narrow_batches(spark)
    source = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    keys = part_keys(spark, source)
    counts = _counts(source, keys, least, bits)
    sizes = counts.where("level = 0").select("lang", F.col("f").alias("n"))
    phrases = counts.where("level > 0").select("lang", "level", F.array(*_COLUMNS).alias("w"), "f")
    cuts = (phrases.where("level > 1")
            .select("lang", "level", "w", F.col("f").alias("a"), F.explode(F.expr("sequence(1, level - 1)")).alias("k")))
    cuts = cuts.select("lang", "level", "a", "k", F.slice("w", 1, F.col("level")).alias("w"))
    cuts = cuts.withColumn("first", F.slice("w", 1, F.col("k"))).withColumn("rest", F.expr("slice(w, k + 1, level - k)"))
    table = phrases.select("lang", F.slice("w", 1, F.col("level")).alias("p"), "f")
    left = table.select("lang", F.col("p").alias("first"), F.col("f").alias("l"))
    right = table.select("lang", F.col("p").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(sizes, "lang")
    wide = "cast({} as decimal(19, 0))"
    score = F.expr(f"cast(({wide.format('a')} * {wide.format('n')}) * 1000BD div ({wide.format('l')} * {wide.format('r')}) as long)")
    lowest = (scored.withColumn("score", score).groupBy("lang", "w", "a", "n")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("s")).select("lang", "w", "a", "n", "s.score", "s.l", "s.r"))
    longer = cuts.where("k = 1 and level > 2").select("lang", F.explode(F.array(F.expr("slice(w, 1, level - 1)"), F.expr("slice(w, 2, level - 1)"))).alias("w"), "a")
    longer = longer.groupBy("lang", "w").agg(F.max("a").alias("in_longer"))
    kept = lowest.join(longer, ["lang", "w"], "left").where("in_longer is null or 100 * in_longer < 100 * a").drop("in_longer")
    best = [F.col("score").desc(), F.col("a").desc()]
    if top is not None:  # with all ties of the last place, which the words will settle
        kept = _leading(kept, "w", best, top, F.rank)
    kept = stored(kept, "phrases")
    words = _spelled(source, kept.select(F.explode("w").alias("id")).distinct(), keys, bits)
    spelled = (kept.select("lang", "w", F.posexplode("w").alias("place", "id")).join(words, "id").groupBy("lang", "w")
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    ranked = kept.join(spelled, ["lang", "w"])
    order = [*best, F.col("phrase").asc()]
    if top is not None:
        ranked = _leading(ranked, "phrase", order, top, F.row_number)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
