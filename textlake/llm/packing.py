"""Best-fit packing of token sequences by minimum bin slack."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.blocks import chunks, narrow_batches, release, stored, text_bytes, worker_cache
from textlake.llm.words import word_spans

#: Words and ids that an encoder keeps at most, some 30 MB, and bytes of text that are encoded at once.
CACHE_WORDS, CACHE_IDS, TEXT_BYTES = 500_000, 4_000_000, 512 << 10
#: New words that the tokenizer gets in one call, and what stands between them there: a word of one id.
JOINED, MARK = 100, b" \x01 "
_LETTER, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP[[*b".,;:!?"]] = True
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordEncoder:
    """Ids of whole texts, for lower-casing tokenizers that never join text across ASCII white space, nor an ASCII
    letter to a stop (``.,;:!?``) after it: a word ends there too, so that it is the same word before a stop.

    Each distinct word is encoded once and kept, by its hash, in sorted arrays; beyond ``CACHE_WORDS`` or
    ``CACHE_IDS`` the arrays are emptied, so memory is bounded and every text gets its exact ids. New words are encoded
    ``JOINED`` at a time, since a call costs more than a word. A worker keeps its encoder from task to task, until a
    task of another kind releases it.
    """

    def __init__(self, path: str):
        # Spark runs a task per core; more threads in each would only get in each other's way
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.flat, self.size, self.begin = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _look_up(self, keys: np.ndarray) -> np.ndarray:
        """Place of each known key, else -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.place[at], -1)

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each); words that hold the mark's own id are encoded one by one."""
        mark = self._ids([MARK])[0]
        flat, size = [], []
        for i in range(0, len(words), JOINED * JOINED):  # what the tokenizer returns is large
            groups = [words[k:k + JOINED] for k in range(i, min(i + JOINED * JOINED, len(words)), JOINED)]
            for group, ids in zip(groups, self._ids([MARK.join(g) + MARK for g in groups])):
                cuts = np.flatnonzero(ids == mark[0]) if len(mark) == 1 else mark[:0]
                if len(cuts) == len(group):
                    flat.append(np.delete(ids, cuts))
                    size.append(np.diff(cuts, prepend=-1) - 1)
                else:
                    single = self._ids(group)
                    flat += single
                    size.append(np.array([len(x) for x in single]))
        return np.concatenate(flat), np.concatenate(size).astype(np.int32)

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Keep the ids of new words; ``keys`` ascend."""
        flat, size = self._encode_words(words)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.place = np.insert(self.place, at, np.arange(len(self.size), len(self.size) + len(size), dtype=np.int32))
        self.begin = np.concatenate([self.begin, (len(self.flat) + np.cumsum(size) - size).astype(np.int32)])
        self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n + 1 offsets), for UTF-8 bytes of texts, one after another."""
        raw = data.tobytes()
        stops = np.flatnonzero(_LETTER[data[:-1]] & _STOP[data[1:]]) + 1
        # the tokenizer lower-cases words itself, but not the strings of its special tokens
        hashes, starts, ends = word_spans(data, np.concatenate([offsets, stops]), lower=b"<|" not in raw)
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE_WORDS or len(self.flat) > CACHE_IDS:
            self._clear()
        place = self._look_up(keys)
        new = np.flatnonzero(place < 0)
        if len(new):
            words = [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            self._learn(keys[new], words)
            place = self._look_up(keys)
        place = place[back]
        size = self.size[place]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.begin[place] - total[:-1], size)]
        return ids, total[np.searchsorted(starts, offsets)]


def _encoder(path: str) -> WordEncoder:
    """The worker's encoder; a function of the module, since tasks get copies of what they name themselves."""
    if path not in worker_cache:
        worker_cache[path] = WordEncoder(path)
    return worker_cache[path]


def pieces(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of at most ``size`` ids of every document: ids of the whole text, then ``end_id``.

    Null text counts as empty, so it is one piece of one id. A null doc_id stays null.
    """
    def cut(batches):
        release(tokenizer)
        encoder = _encoder(tokenizer)
        for batch in chunks(batches, limit=TEXT_BYTES):
            ids, at = encoder.encode(*text_bytes(batch.column("text")))
            rows = []
            for doc, lo, hi in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                own = np.empty(hi - lo + 1, "<u4")
                own[:-1], own[-1] = ids[lo:hi], end_id
                for n, start in enumerate(range(0, len(own), size)):
                    piece = own[start:start + size]
                    rows.append((doc, n, start, len(piece), zlib.crc32(piece.tobytes())))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
    narrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, _PIECES)


def fullest(counts: dict[int, int], first: int, size: int) -> list[int]:
    """Lengths of the fullest bin that holds ``first``, by subset sums in the bits of an int.

    Bit s of ``reach`` says that lengths seen so far can sum to s. Lengths go from long to
    short and stop when the bin can be filled; the states are walked back for the choice.
    """
    room, full = size - first, 1 << (size - first)
    mask, reach, states = (full << 1) - 1, 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left = min(counts[length] - (length == first), room // length)
        step = 1
        while left > 0:
            use = min(step, left)
            states.append((length, use, reach))
            reach |= (reach << (length * use)) & mask
            left -= use
            step *= 2
        if reach & full:
            break
    total, chosen = reach.bit_length() - 1, [first]
    for length, use, before in reversed(states):
        if not before >> total & 1:
            chosen += [length] * use
            total -= length * use
    return chosen


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Bins for a histogram of lengths: (length, first rank, ranks, first sequence, offset) per run.

    The longest length left opens a bin; its fullest combination is used as often as the
    counts allow, then removed. Histogram and plan depend on ``size``, not on the rows.
    """
    counts = {n: c for n, c in histogram.items() if c > 0}
    taken = dict.fromkeys(counts, 0)
    out, sequence = [], 0
    while counts:
        chosen = fullest(counts, max(counts), size)
        uses = {n: chosen.count(n) for n in set(chosen)}
        times = min(counts[n] // k for n, k in uses.items())
        offset = 0
        for n in chosen:
            out.append((n, taken[n], times, sequence, offset))
            taken[n] += times
            offset += n
        for n, k in uses.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        sequence += times
    return out


def best_fit(found: DataFrame, size: int = 4096) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces, in as few sequences as minimum bin slack finds.

    Pieces are counted per length (at most ``size`` lengths, the only rows on the driver)
    and ranked within their length in buckets, so that a length with many pieces is spread.
    Ranks are looked up in the plan. Equal pieces may change places; an empty input gives no rows.
    """
    spark = found.sparkSession
    buckets = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = found.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    found = stored(found, "pieces")
    small = found.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in small.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    rows = np.array(plan(histogram, size), np.int64).reshape(-1, 5)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    shared = spark.sparkContext.broadcast((rows, (rows[:, 0] << 48) + rows[:, 1]))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    skip = small.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    local = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (found.withColumn("_rank", F.row_number().over(local) - 1).join(skip, ["length", "_bucket"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_skip")).alias("_rank")))

    def place(batches):
        table, keys = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            got = table[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(got[:, 3] + rank - got[:, 1]), pa.array(got[:, 4])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return ranked.mapInArrow(place, _PIECES + ", sequence_id long, offset long")
