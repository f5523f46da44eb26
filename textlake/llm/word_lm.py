"""Katz back-off bigram model over whole words: every word of the training texts keeps counts of its own.

Words get numbers in the order of their counts, so that the count of a number follows from a table of the
distinct counts (fewer than the root of twice the tokens) and a bigram is two numbers in 64 bits. Bigram counts up
to ``CUT`` get Good-Turing discounts; what a context's discounts leave goes to the words not seen after it, by their
unigram shares. In these, words never seen share as much as the hapaxes have.

Bigrams are dealt by context, so a part has all that the back-off weights of its contexts take. The contexts that are too
frequent for that (``SPREAD`` per shuffle partition at most, and the start of a text) are dealt by bigram, and their sums added up.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.blocks import block, exchange, mix, narrow_batches, part_keys, read, release, runs, split, stored, task_number
from textlake.llm.ngram_lm import CUT, _flushes, _sum, good_turing

#: A context with more than 1/SPREAD of a shuffle partition's tokens is dealt by bigram.
SPREAD = 8

_HEAD_SQL = "batch long, part int, ids binary, sizes binary, train binary, own binary, token binary, base binary, known binary"
_HEAD = pa.schema([("batch", pa.int64()), ("part", pa.int32()), *[(c, pa.binary()) for c in ("ids", "sizes", "train", "own", "token", "base", "known")]])
_COUNT_SQL = "part int, key binary, n binary"
_COUNT = pa.schema([("part", pa.int32()), ("key", pa.binary()), ("n", pa.binary())])
_ASK_SQL = "part int, key binary, n binary, of int, batch long, home int"
_ANSWER_SQL = "part int, batch long, of int, value binary"
_ANSWER = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("of", pa.int32()), ("value", pa.binary())])


def squeeze(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    raw = x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def loosen(column: pa.Array, dtype) -> np.ndarray:
    """All numbers of a column of squeezed arrays."""
    parts, width = [np.zeros(0, dtype)], np.dtype(dtype).itemsize
    for value in column:
        data = value.as_py()
        raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
        parts.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(dtype).ravel())
    return np.concatenate(parts)


@dataclass
class Model:
    """What every task needs: tables of the distinct counts, and the sums of the contexts dealt by bigram."""

    total: int
    kinds: int
    docs: int
    starts: np.ndarray     # first number of each distinct count, counts descending
    counts: np.ndarray     # these counts; 0 from the last start on
    hot: int               # numbers below this are dealt by bigram, as is the start of a text
    new: float             # what words never seen share, as a count
    discount: np.ndarray = field(default_factory=lambda: np.ones(CUT + 1))
    hot_kept: np.ndarray | None = None
    hot_seen: np.ndarray | None = None

    @property
    def unseen(self) -> int:
        return self.kinds

    @property
    def start(self) -> int:
        return self.kinds + 1

    def count(self, number: np.ndarray) -> np.ndarray:
        return self.counts[np.searchsorted(self.starts, number, side="right") - 1]

    def context(self, number: np.ndarray) -> np.ndarray:
        return np.where(number == self.start, self.docs, self.count(number))

    def share(self, number: np.ndarray) -> np.ndarray:
        return np.where(number == self.unseen, self.new, self.count(number)) / (self.total + self.new)

    def is_hot(self, number: np.ndarray) -> np.ndarray:
        return (number < self.hot) | (number == self.start)

    def kept(self, n: np.ndarray) -> np.ndarray:
        return np.where(n <= CUT, self.discount[np.minimum(n, CUT)] * n, n)

    def parts(self, key: np.ndarray, n_parts: int) -> np.ndarray:
        context = key >> np.uint64(32)
        return (mix(np.where(self.is_hot(context.astype(np.int64)), key, context)) % np.uint64(n_parts)).astype(np.int64)

    def pairs(self, token: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Number of the word before (or of the start) and of the word, in 64 bits."""
        before = np.empty(len(token), np.uint64)
        before[1:] = token[:-1]
        before[np.cumsum(sizes) - sizes] = self.start
        return before << np.uint64(32) | token.astype(np.uint64)

    def leaves(self, a: np.ndarray, kept: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Back-off weight of each context, negative where one more count makes room: where all its counts are above CUT."""
        whole = self.context(a)
        tight = whole - kept < 0.25
        back = np.where(whole > 0, (1 - kept / np.maximum(whole + tight, 1)) / (1 - np.where(whole > 0, seen, 0)), 1.0)
        return np.where(tight, -back, back)

    def sums(self, table: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(contexts, what their discounts keep, share of the words seen after them) of a sorted table, and a row for none."""
        a, b = (table >> np.uint64(32)).astype(np.int64), (table & np.uint64(0xFFFFFFFF)).astype(np.int64)
        starts = runs(a)[:-1]
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(1), np.zeros(1)
        return a[starts], np.append(np.add.reduceat(self.kept(n).astype(float), starts), 0), np.append(np.add.reduceat(self.share(b), starts), 0)

    def own_contexts(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(different contexts of ascending keys, which are hot, place of each key's context)."""
        a = (key >> np.uint64(32)).astype(np.int64)
        at = runs(a)
        own = a[at[:-1]]
        return own, self.is_hot(own), np.repeat(np.arange(len(own)), np.diff(at)) if len(own) else np.zeros(0, np.int64)

    def logs(self, key: np.ndarray, count: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """log10 of the bigrams' probabilities by their counts and the weights of their contexts that are not hot."""
        own, hot, at = self.own_contexts(key)
        back = np.empty(len(own))
        back[~hot] = weight
        i = np.where(own[hot] == self.start, self.hot, own[hot])
        back[hot] = self.leaves(own[hot], self.hot_kept[i], self.hot_seen[i])
        room, b = np.maximum(self.context(own) + (back < 0), 1), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return np.log10(np.where(count > 0, self.kept(count) / room[at], np.abs(back)[at] * self.share(b)))


def _table(blocks: DataFrame, keys: np.ndarray, label: str) -> DataFrame:
    """Counts by key, one sorted row per part, stored in the shared folder."""
    def add(batches):
        rows = {}
        for batch in batches:
            for i, p in enumerate(batch.column("part").to_pylist()):
                row = batch.slice(i, 1)
                rows.setdefault(p, []).append((loosen(row.column("key"), np.uint64), loosen(row.column("n"), np.int64)))
        yield block([(p, *map(squeeze, _sum(*[np.concatenate(x) for x in zip(*got)]))) for p, got in rows.items()], _COUNT)
    return stored(exchange(blocks, keys, add, _COUNT_SQL), label)


def _ask(number: int, home: int, part: np.ndarray, keys: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    rows = list(split(part, len(keys), key))
    return pa.RecordBatch.from_arrays(
        [pa.array([int(keys[p]) for p, _ in rows], pa.int32()), pa.array([squeeze(k) for _, (k,) in rows], pa.binary()), pa.nulls(len(rows), pa.binary()),
         pa.array([p for p, _ in rows], pa.int32()), pa.array([number] * len(rows), pa.int64()), pa.array([home] * len(rows), pa.int32())],
        ["part", "key", "n", "of", "batch", "home"])


def _round(heads: DataFrame, ask, table: DataFrame, answer, keys: np.ndarray, close, schema: str) -> DataFrame:
    """Questions of the heads meet the table's parts, the answers meet their heads again.

    ``ask(head)`` gives (parts, keys); ``answer(part, table keys, counts)`` a function from keys to bytes; ``close(head, answers by part)`` a batch.
    """
    n_parts = len(keys)

    def asks(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                head = batch.slice(i, 1)
                yield _ask(head.column("batch")[0].as_py(), head.column("part")[0].as_py(), *ask(head, n_parts, keys))

    def answers(batches):
        held, ready = [], {}
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                p = row.column("part")[0].as_py()
                key = loosen(row.column("key"), np.uint64)
                if row.column("n")[0].is_valid:
                    ready[p] = answer(p, key, loosen(row.column("n"), np.int64))
                    continue
                if p not in ready:
                    ready[p] = answer(p, np.zeros(0, np.uint64), np.zeros(0, np.int64))
                out.append((row.column("home")[0].as_py(), row.column("batch")[0].as_py(), row.column("of")[0].as_py(), ready[p](key)))
            yield block(out, _ANSWER)

    def closed(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                held.setdefault(row.column("batch")[0].as_py(), []).append(row)
        while held:
            _, rows = held.popitem()
            head = next(r for r in rows if r.column("sizes")[0].is_valid)
            yield close(head, {r.column("of")[0].as_py(): r.column("value") for r in rows if r is not head}, n_parts)

    asked = heads.mapInArrow(asks, _ASK_SQL)
    none = F.lit(None)
    mixed = asked.unionByName(table.select("part", "key", "n", none.cast("int").alias("of"), none.cast("long").alias("batch"), none.cast("int").alias("home")))
    found = mixed.repartition(n_parts, "part").sortWithinPartitions(F.col("n").isNull()).mapInArrow(answers, _ANSWER_SQL)
    both = heads.unionByName(found, allowMissingColumns=True)
    return exchange(both, keys, closed, schema)


def _filled(values: dict, part: np.ndarray, n_parts: int, dtype) -> np.ndarray:
    """The answers in the order of the questions."""
    out, order = np.zeros(len(part), dtype), np.argsort(part, kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=n_parts))
    for p, value in values.items():
        out[order[ends[p - 1] if p else 0:ends[p]]] = loosen(value, dtype)
    return out


def _word_parts(word: np.ndarray, n_parts: int) -> np.ndarray:
    return (mix(word) % np.uint64(n_parts)).astype(np.int64)


def _numbers(words: DataFrame) -> tuple[Model, dict]:
    """The model of single words, and for each part its distinct counts with the number of the first word that has it."""
    def few(batches):
        for batch in batches:
            for i, p in enumerate(batch.column("part").to_pylist()):
                n, size = np.unique(loosen(batch.column("n").slice(i, 1), np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(n), pa.int32()), pa.array(n), pa.array(size)], ["part", "n", "size"])
    rows = sorted(((-r["n"], r["part"], r["size"]) for r in words.mapInArrow(few, "part int, n long, size long").collect()))
    at, total, once, starts, counts, firsts = 0, 0, 0, [], [], {}
    for minus, p, size in rows:
        if not counts or counts[-1] != -minus:
            starts.append(at)
            counts.append(-minus)
        firsts.setdefault(p, {})[-minus] = at
        at, total, once = at + size, total - minus * size, once + size * (minus == -1)
    if at >= (1 << 32) - 2:
        raise ValueError(f"{at} different words; a word's number has 32 bits")
    model = Model(total, at, 0, np.array([*starts, at], np.int64), np.array([*counts, 0], np.int64), 0, float(once or 0.5))
    return model, {p: (np.array(sorted(f), np.int64), np.array([f[n] for n in sorted(f)], np.int64)) for p, f in firsts.items()}


def score(docs: DataFrame, train_where) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every whole text.

    Tokens are the lower-cased words and one end. ``base_score`` adds log10((c + 0.1) / (N + 0.1 (V + 1))); ``score`` is the
    model's log10 probability. Learning uses the rows where ``train_where`` holds (null counts as false). Null text is empty:
    its end alone is scored. Without training documents every token is new. Repeated rows are scored apart.
    """
    spark = docs.sparkSession
    narrow_batches(spark)
    keys = part_keys(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(train_where, F.lit(False)).alias("train"))

    def begin(batches):
        release()
        for number, (token, at, batch) in enumerate(_flushes(batches)):
            name = (task_number() << 24) + number
            home = int(keys[int(mix(np.array([name], np.uint64))[0] % np.uint64(len(keys)))])
            own, back = np.unique(token, return_inverse=True)
            ids = batch.column("doc_id").combine_chunks().fill_null(-(1 << 63)).to_numpy()
            train = batch.column("train").combine_chunks().to_numpy(zero_copy_only=False).astype(np.uint8)
            yield block([(name, home, squeeze(ids), squeeze(np.diff(at).astype(np.int64)), squeeze(train), own, squeeze(back.astype(np.uint32)), None, None)], _HEAD)
    heads = stored(slim.mapInArrow(begin, _HEAD_SQL), "heads")

    def word_counts(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                head = batch.slice(i, 1)
                own, use = read(head.column("own"), np.uint64), np.repeat(loosen(head.column("train"), np.uint8), loosen(head.column("sizes"), np.int64))
                n = np.bincount(loosen(head.column("token"), np.uint32)[use > 0], minlength=len(own))
                own, n = own[n > 0], n[n > 0]
                yield block([(int(keys[p]), squeeze(k), squeeze(c)) for p, (k, c) in split(_word_parts(own, len(keys)), len(keys), own, n)], _COUNT)
    words = _table(heads.mapInArrow(word_counts, _COUNT_SQL), keys, "words")
    model, firsts = _numbers(words)
    model.docs = slim.where("train").count()
    model.hot = int(model.starts[np.searchsorted(-model.counts, -(model.total / (SPREAD * len(keys))), side="left")]) if model.total else 0
    shared, numbers = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(firsts)
    scale = model.total + 0.1 * (model.kinds + 1)

    def ask_words(head, n_parts, keys):
        own = read(head.column("own"), np.uint64)
        return _word_parts(own, n_parts), keys, own

    def answer_words(part, table, n):
        unseen, number = shared.value.unseen, np.zeros(0, np.int64)
        if len(table):
            counts, first = numbers.value[part]
            order = np.argsort(n, kind="stable")
            group = np.searchsorted(counts, n[order])
            number = np.empty(len(n), np.int64)
            number[order] = first[group] + np.arange(len(n)) - np.searchsorted(group, group)

        def give(key):
            i = np.minimum(np.searchsorted(table, key), max(len(table) - 1, 0))
            return squeeze((np.where(table[i] == key, number[i], unseen) if len(table) else np.full(len(key), unseen)).astype(np.uint32))
        return give

    def close_words(head, values, n_parts):
        own, sizes = read(head.column("own"), np.uint64), loosen(head.column("sizes"), np.int64)
        token = _filled(values, _word_parts(own, n_parts), n_parts, np.uint32)[loosen(head.column("token"), np.uint32)]
        count, doc = shared.value.count(token.astype(np.int64)), np.repeat(np.arange(len(sizes)), sizes)
        base = np.bincount(doc, weights=np.log10((count + 0.1) / scale), minlength=len(sizes))
        known = np.bincount(doc, weights=count > 0, minlength=len(sizes)).astype(np.int64)
        return block([(head.column("batch")[0].as_py(), head.column("part")[0].as_py(), *[head.column(c)[0].as_py() for c in ("ids", "sizes", "train")],
                       None, squeeze(token), base, squeeze(known))], _HEAD)
    coded = stored(_round(heads, ask_words, words, answer_words, keys, close_words, _HEAD_SQL), "coded")

    def pair_counts(batches):
        m = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                head = batch.slice(i, 1)
                sizes = loosen(head.column("sizes"), np.int64)
                use = np.repeat(loosen(head.column("train"), np.uint8), sizes) > 0
                key, n = np.unique(m.pairs(loosen(head.column("token"), np.uint32), sizes)[use], return_counts=True)
                yield block([(int(keys[p]), squeeze(k), squeeze(c)) for p, (k, c) in split(m.parts(key, len(keys)), len(keys), key, n)], _COUNT)
    pairs = _table(coded.mapInArrow(pair_counts, _COUNT_SQL), keys, "pairs")

    def few(batches):
        for batch in batches:
            n = loosen(batch.column("n"), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(range(CUT + 2)), pa.array(np.bincount(n[n <= CUT + 1], minlength=CUT + 2))], ["n", "size"])
    sizes = {r["n"]: r["size"] for r in pairs.mapInArrow(few, "n long, size long").groupBy("n").agg(F.sum("size").alias("size")).collect()}
    model.discount = good_turing(np.array([sizes.get(i, 0) for i in range(CUT + 2)]))
    learned = spark.sparkContext.broadcast(model)

    def hot_sums(batches):
        m = learned.value
        for batch in batches:
            key, n = loosen(batch.column("key"), np.uint64), loosen(batch.column("n"), np.int64)
            a, b = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            hot = m.is_hot(a)
            own, at = np.unique(a[hot], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(at, weights=m.kept(n[hot]), minlength=len(own))),
                                              pa.array(np.bincount(at, weights=m.share(b[hot]), minlength=len(own)))], ["a", "kept", "seen"])
    kept, seen = np.zeros(model.hot + 1), np.zeros(model.hot + 1)
    for r in pairs.mapInArrow(hot_sums, "a long, kept double, seen double").groupBy("a").agg(F.sum("kept").alias("k"), F.sum("seen").alias("s")).collect():
        i = model.hot if r["a"] == model.start else r["a"]
        kept[i], seen[i] = r["k"], r["s"]
    model.hot_kept, model.hot_seen = kept, seen
    whole = spark.sparkContext.broadcast(model)

    def questions(head):
        m, sizes = whole.value, loosen(head.column("sizes"), np.int64)
        key, back = np.unique(m.pairs(loosen(head.column("token"), np.uint32), sizes), return_inverse=True)
        return m, key, back, sizes

    def ask_pairs(head, n_parts, keys):
        m, key, _, _ = questions(head)
        return m.parts(key, n_parts), keys, key

    def answer_pairs(part, table, n):
        m = whole.value
        contexts, kept, seen = m.sums(table, n)

        def give(key):
            i = np.minimum(np.searchsorted(table, key), max(len(table) - 1, 0))
            count = np.where(table[i] == key, n[i], 0) if len(table) else np.zeros(len(key), np.int64)
            own, hot, _ = m.own_contexts(key)
            own = own[~hot]
            j = np.searchsorted(contexts, own)
            j = np.where(contexts[np.minimum(j, max(len(contexts) - 1, 0))] == own, j, -1) if len(contexts) else np.full(len(own), -1)
            counts = squeeze(count)
            return len(counts).to_bytes(8, "little") + counts + m.leaves(own, kept[j], seen[j]).tobytes()
        return give

    def close_pairs(head, values, n_parts):
        m, key, back, sizes = questions(head)
        part = m.parts(key, n_parts)
        order, ends, logs = np.argsort(part, kind="stable"), np.cumsum(np.bincount(part, minlength=n_parts)), np.zeros(len(key))
        for p, value in values.items():
            at, raw = order[ends[p - 1] if p else 0:ends[p]], value[0].as_py()
            end = 8 + int.from_bytes(raw[:8], "little")
            logs[at] = m.logs(key[at], loosen(pa.array([raw[8:end]]), np.int64), np.frombuffer(raw, np.float64, offset=end))
        logs = logs[back]
        ids, n = loosen(head.column("ids"), np.int64), len(sizes)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=ids == -(1 << 63)), pa.array(loosen(head.column("train"), np.uint8) == 0), pa.array(sizes), pa.array(loosen(head.column("known"), np.int64)),
             pa.array(np.full(n, m.total)), pa.array(read(head.column("base"), np.float64)), pa.array(np.bincount(np.repeat(np.arange(n), sizes), weights=logs, minlength=n))],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return _round(coded, ask_pairs, pairs, answer_pairs, keys, close_pairs,
                  "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
