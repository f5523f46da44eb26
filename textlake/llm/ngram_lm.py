"""Katz back-off language model: counts, tables and scores as block shuffles.

The model has two levels. A word's class is the word itself when it makes more than 1/``SHARE`` of all
training tokens (so there are fewer than ``SHARE`` such words, whatever the corpus), else the class of rare words.
Classes follow a Katz bigram model: counts up to ``CUT`` get Good-Turing discounts, and what
a context's discounts leave goes to the classes not seen after it, by their unigram shares; the
back-off weight is normalised exactly over them. A rare word has its share of the
rare class, with the class's count of hapaxes left to words never seen.

Class bigrams and rare words are counted and stored in tables dealt by hash; scoring deals
the tokens the same way, so each part evaluates its tokens against its part of the tables.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.blocks import block, chunks, exchange, mix, narrow_batches, part_keys, read, runs, split, stored, task_number, text_bytes
from textlake.llm.words import one_hash, word_hashes

#: Words above a share of 1/SHARE of the training tokens are classes of their own.
SHARE = 65_000
CUT = 5
RARE, START, END, FIRST = 0, 1, 2, 3
#: The end of a text; white space cannot be in a word.
_END = one_hash(" end ")
#: Tokens that a task gathers before it sends them.
FLUSH = 1_000_000

_COUNT = pa.schema([("part", pa.int32()), ("key", pa.binary()), ("n", pa.binary())])
_COUNT_SQL = "part int, key binary, n binary"


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, and their n + 1 offsets."""
    words, at = word_hashes(*text_bytes(batch.column("text")))
    out = np.full(len(words) + len(at) - 1, _END, np.uint64)
    ends = at[1:] + np.arange(len(at) - 1)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = words
    return out, np.concatenate([[0], ends + 1])


def _flushes(batches, use=None):
    """Tokens, offsets and batches, ``FLUSH`` tokens at a time."""
    held, size = [], 0
    for batch in chunks(batches):
        if use is not None:
            batch = batch.filter(batch.column(use))
        token, at = _tokens(batch)
        held.append((token, at, batch))
        size += len(token)
        if size >= FLUSH:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    shift = np.cumsum([0, *[len(t) for t, _, _ in held]])
    at = np.concatenate([a[:-1] + s for (_, a, _), s in zip(held, shift)] + [shift[-1:]])
    return np.concatenate([t for t, _, _ in held]), at, pa.Table.from_batches([b for _, _, b in held])


def _sum(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    starts = runs(key[order])
    return key[order][starts[:-1]], np.add.reduceat(n[order], starts[:-1]) if len(key) else n


def _table(blocks: DataFrame, keys: np.ndarray, dtype, label: str) -> DataFrame:
    """Counts by key, one sorted row per part, stored in the shared folder."""
    def add(batches):
        rows = {}
        for batch in batches:
            for p in set(batch.column("part").to_pylist()):
                some = batch.filter(pa.array(batch.column("part").to_numpy() == p))
                rows.setdefault(p, []).append((read(some.column("key"), dtype), read(some.column("n"), np.int64)))
        yield block([(p, *_sum(*[np.concatenate(x) for x in zip(*got)])) for p, got in rows.items()], _COUNT)
    return stored(exchange(blocks, keys, add, _COUNT_SQL), label)


def _count_blocks(docs: DataFrame, keys: np.ndarray, items, dtype) -> DataFrame:
    """Blocks of (key, count) of the training documents; ``items`` makes keys of tokens."""
    n_parts = len(keys)

    def emit(batches):
        for token, at, _ in _flushes(batches, "train"):
            key, n = np.unique(items(token, at), return_counts=True)
            part = (mix(key.astype(np.uint64)) % np.uint64(n_parts)).astype(np.int64)
            yield block([(int(keys[p]), k.astype(dtype), c.astype(np.int64)) for p, (k, c) in split(part, n_parts, key, n)], _COUNT)
    return docs.mapInArrow(emit, _COUNT_SQL)


def _stats(table: DataFrame) -> list:
    """Per part: number of keys, sum of counts, and how many keys have count 1, 2, ... CUT + 1."""
    def run(batches):
        for batch in batches:
            n = read(batch.column("n"), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([len(n)]), pa.array([int(n.sum())]), pa.array([np.bincount(n[n <= CUT + 1], minlength=CUT + 2).tolist()])], ["keys", "total", "few"])
    rows = table.mapInArrow(run, "keys long, total long, few array<long>")
    few = [F.sum(F.col("few")[i]).alias(f"n{i}") for i in range(CUT + 2)]
    r = rows.agg(F.sum("keys").alias("keys"), F.sum("total").alias("total"), *few).first()
    return [r["keys"] or 0, r["total"] or 0, np.array([r[f"n{i}"] or 0 for i in range(CUT + 2)])]


@dataclass
class Model:
    """What every task needs; fewer than SHARE entries in each array."""

    total: int
    kinds: int
    words: np.ndarray      # sorted hashes of the words that are classes
    counts: np.ndarray     # their counts
    share: np.ndarray      # unigram share of each class
    discount: np.ndarray   # of counts 0 .. CUT
    spill: np.ndarray      # by context class: 1 where its seen counts get a further count to back off with
    context: np.ndarray    # count of each context class
    backoff: np.ndarray    # weight of the unseen classes after each context
    rare_total: int
    rare_once: int

    def classes(self, token: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.words, token), max(len(self.words) - 1, 0))
        found = self.words[i] == token if len(self.words) else np.zeros(len(token), bool)
        return np.where(token == _END, END, np.where(found, i + FIRST, RARE))

    def seen_share(self, context: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Katz share of a class bigram that has a count."""
        kept = np.where(count <= CUT, self.discount[np.minimum(count, CUT)] * count, count)
        return kept / np.maximum(self.context[context] + self.spill[context], 1)


def _pairs(classes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Context class * 65536 + class of every token; the first token's context is START."""
    context = np.empty(len(classes), np.int64)
    context[1:] = classes[:-1]
    context[at[:-1]] = START
    return (context << 16 | classes).astype(np.uint32)


def good_turing(few: np.ndarray) -> np.ndarray:
    """Katz's discounts of counts 1 .. CUT (index 0 is unused), from the numbers of keys with count 1 .. CUT + 1.

    Where the counts of counts don't give a discount between 0 and 1, (count - 1/2) / count stands in.
    """
    out = np.ones(CUT + 1)
    for r in range(1, CUT + 1):
        d = None
        if few[1] and few[r]:
            last = (CUT + 1) * few[CUT + 1] / few[1]
            if last < 1:
                d = ((r + 1) * few[r + 1] / few[r] / r - last) / (1 - last)
        out[r] = d if d is not None and 0 < d < 1 else (r - 0.5) / r
    return out


def train(docs: DataFrame, keys: np.ndarray) -> tuple[Model, DataFrame, DataFrame]:
    """Model, bigram table and word table of the documents where ``train`` is true."""
    words = _table(_count_blocks(docs, keys, lambda token, at: token, np.uint64), keys, np.uint64, "words")
    kinds, total, _ = _stats(words)

    def common(batches):
        for batch in batches:
            key, n = read(batch.column("key"), np.uint64), read(batch.column("n"), np.int64)
            pick = (n * SHARE > total) & (key != _END)
            yield pa.RecordBatch.from_arrays([pa.array(key[pick].view(np.int64)), pa.array(n[pick])], ["word", "n"])
    found = sorted((np.uint64(r["word"] % (1 << 64)), r["n"]) for r in words.mapInArrow(common, "word long, n long").collect())
    own, counts = np.array([w for w, _ in found], np.uint64), np.array([n for _, n in found], np.int64)
    n_docs = docs.where("train").count()

    size = len(own) + FIRST
    class_count = np.zeros(size, np.int64)
    class_count[FIRST:] = counts
    class_count[END] = n_docs
    class_count[RARE] = total - counts.sum() - n_docs
    targets = class_count.astype(np.float64)
    targets[START] = 0
    share = targets + 0.5
    share[START] = 0
    share /= share.sum()
    context = class_count.copy()
    context[START], context[END] = n_docs, 0
    model = Model(total, kinds, own, counts, share, np.ones(CUT + 1), np.zeros(size, np.int64), context, np.ones(size), int(class_count[RARE]), 0)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bigrams = _table(_count_blocks(docs, keys, lambda token, at: _pairs(shared.value.classes(token), at), np.uint32), keys, np.uint32, "bigrams")
    model.discount = good_turing(_stats(bigrams)[2])
    discount = model.discount

    def left(batches):
        for batch in batches:
            key, n = read(batch.column("key"), np.uint32), read(batch.column("n"), np.int64)
            c, w = (key >> 16).astype(np.int64), (key & 0xFFFF).astype(np.int64)
            kept = np.bincount(c, weights=np.where(n <= CUT, discount[np.minimum(n, CUT)] * n, n), minlength=size)
            seen = np.bincount(c, weights=share[w], minlength=size)
            used = np.flatnonzero(np.bincount(c, minlength=size))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(kept[used]), pa.array(seen[used])], ["context", "kept", "seen"])
    kept, seen = np.zeros(size), np.zeros(size)
    for r in bigrams.mapInArrow(left, "context long, kept double, seen double").groupBy("context").agg(F.sum("kept").alias("k"), F.sum("seen").alias("s")).collect():
        kept[r["context"]], seen[r["context"]] = r["k"], r["s"]
    whole = np.maximum(context, 1)
    # a context whose counts are all above CUT leaves nothing: one more count makes room
    model.spill = ((context > 0) & (context - kept < 0.25)).astype(np.int64)
    rest = 1 - kept / (whole + model.spill)
    unseen = np.maximum(1 - seen, 1e-300)
    model.backoff = np.where(context > 0, rest / unseen, 1.0)

    def once(batches):
        for batch in batches:
            key, n = read(batch.column("key"), np.uint64), read(batch.column("n"), np.int64)
            pick = (n * SHARE <= total) & (key != _END) & (n == 1)
            yield pa.RecordBatch.from_arrays([pa.array([int(pick.sum())])], ["n"])
    model.rare_once = words.mapInArrow(once, "n long").agg(F.sum("n")).first()[0] or 0
    return model, bigrams, words


_ASK = [("kind", pa.int32()), ("part", pa.int32()), ("batch", pa.int64()), ("home", pa.int32()), ("key", pa.binary()), ("n", pa.binary()), ("width", pa.binary()), ("doc", pa.binary())]
_ASK_SQL = "kind int, part int, batch long, home int, key binary, n binary, width binary, doc binary"
_ANSWER = [("part", pa.int32()), ("batch", pa.int64()), ("doc", pa.binary()), ("base", pa.binary()), ("known", pa.binary()), ("score", pa.binary())]
_ANSWER_SQL = "part int, batch long, doc binary, base binary, known binary, score binary"
_BIGRAM, _WORD, _BIGRAM_TABLE, _WORD_TABLE, _DOC = 0, 1, 2, 3, 4


def _grouped(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, occurrences of each, documents of the occurrences)."""
    order = np.argsort(key, kind="stable")
    starts = runs(key[order])
    return key[order][starts[:-1]], np.diff(starts), doc[order]


def score(docs: DataFrame, train_where) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every whole text.

    Tokens are the lower-cased words and one end. ``base_score`` adds log10((c + 0.1) / (N + 0.1 (V + 1))); ``score`` is the
    model's log10 probability. Learning uses the rows where ``train_where`` holds (null counts as false). Null text is empty:
    its end alone is scored. Without training documents every token is new. Repeated rows are scored apart.
    """
    spark = docs.sparkSession
    narrow_batches(spark)
    keys = part_keys(spark)
    n_parts = len(keys)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(train_where, F.lit(False)).alias("train"))
    model, bigrams, words = train(slim, keys)
    shared = spark.sparkContext.broadcast(model)
    scale = model.total + 0.1 * (model.kinds + 1)

    def ask(batches):
        m = shared.value
        for number, (token, at, batch) in enumerate(_flushes(batches)):
            name = (task_number() << 24) + number
            home = int(keys[int(mix(np.array([name], np.uint64))[0] % np.uint64(n_parts))])
            doc = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
            classes = m.classes(token)
            own = classes >= FIRST
            count = np.zeros(len(token), np.int64)
            count[own] = m.counts[classes[own] - FIRST]
            count[classes == END] = m.context[START]
            settled = classes != RARE
            logs = np.where(settled, np.log10((count + 0.1) / scale), 0.0)
            n = len(at) - 1
            base, known = np.bincount(doc, weights=logs, minlength=n), np.bincount(doc, weights=settled & (count > 0), minlength=n).astype(np.int64)
            ids = batch.column("doc_id").combine_chunks().fill_null(-(1 << 63)).to_numpy()
            held = (~batch.column("train").combine_chunks().to_numpy(zero_copy_only=False)).astype(np.int8)
            rows = [(_DOC, home, name, home, ids, np.stack([np.diff(at), known], 1).ravel(), base, held)]
            for kind, key, of in ((_BIGRAM, _pairs(classes, at), doc), (_WORD, token[~settled], doc[~settled])):
                part = (mix(key.astype(np.uint64)) % np.uint64(n_parts)).astype(np.int64)
                for p, (k, d) in split(part, n_parts, key, of):
                    k, width, d = _grouped(k, d)
                    rows.append((kind, int(keys[p]), name, home, k, np.zeros(0, np.int64), width.astype(np.int32), d))
            yield block(rows, pa.schema(_ASK))

    def answer(batches):
        m = shared.value
        tables = {_BIGRAM_TABLE: [], _WORD_TABLE: []}
        ready = None
        for batch in batches:
            kinds = batch.column("kind").to_pylist()
            out = []
            for i, kind in enumerate(kinds):
                row = batch.slice(i, 1)
                if kind in tables:
                    tables[kind].append((read(row.column("key"), np.uint32 if kind == _BIGRAM_TABLE else np.uint64), read(row.column("n"), np.int64)))
                    continue
                name, home = row.column("batch")[0].as_py(), row.column("home")[0].as_py()
                if ready is None:
                    ready = {k: _merge(v, t) for (k, v), t in zip(tables.items(), (np.uint32, np.uint64))}
                doc = read(row.column("doc"), np.int32)
                width = read(row.column("width"), np.int32)
                key = read(row.column("key"), np.uint32 if kind == _BIGRAM else np.uint64)
                table, n = ready[_BIGRAM_TABLE if kind == _BIGRAM else _WORD_TABLE]
                at = np.minimum(np.searchsorted(table, key), max(len(table) - 1, 0))
                count = np.where(table[at] == key, n[at], 0) if len(table) else np.zeros(len(key), np.int64)
                if kind == _BIGRAM:
                    context, cls = (key >> 16).astype(np.int64), (key & 0xFFFF).astype(np.int64)
                    with np.errstate(divide="ignore"):
                        logs = np.log10(np.where(count > 0, m.seen_share(context, count), m.backoff[context] * m.share[cls]))
                    values = (np.zeros(len(key)), np.zeros(len(key)), logs)
                else:
                    whole = m.rare_total + m.rare_once
                    share = np.where(count > 0, count / max(whole, 1), m.rare_once / whole if m.rare_once else (1.0 if not whole else 0.5 / (whole + 0.5)))
                    values = (np.log10((count + 0.1) / scale), (count > 0).astype(float), np.log10(share))
                docs_, back = np.unique(doc, return_inverse=True)
                sums = [np.bincount(back, weights=np.repeat(v, width), minlength=len(docs_)) for v in values]
                out.append((home, name, docs_, *([x.astype(np.float64) for x in sums] if kind == _WORD else [np.zeros(0), np.zeros(0), sums[2]])))
            yield block(out, pa.schema(_ANSWER))

    def close(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                held.setdefault(row.column("batch")[0].as_py(), []).append(row)
        for rows in held.values():
            head = next(r for r in rows if r.column("ids")[0].is_valid)
            ids, numbers = read(head.column("ids"), np.int64), read(head.column("numbers"), np.int64).reshape(-1, 2)
            base, held_out = read(head.column("base"), np.float64).copy(), read(head.column("held"), np.int8)
            known, total = numbers[:, 1].copy(), np.zeros(len(ids))
            for r in rows:
                if r is head:
                    continue
                doc, b, k, s = (read(r.column(n), t) for n, t in (("doc", np.int32), ("base", np.float64), ("known", np.float64), ("score", np.float64)))
                if len(b):
                    np.add.at(base, doc, b)
                    np.add.at(known, doc, k.astype(np.int64))
                np.add.at(total, doc, s)
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=ids == -(1 << 63)), pa.array(held_out.astype(bool)), pa.array(numbers[:, 0].copy()), pa.array(known),
                 pa.array(np.full(n, shared.value.total)), pa.array(base), pa.array(total)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    asked = stored(slim.mapInArrow(ask, _ASK_SQL), "asked")
    none = F.lit(None)
    tables = [t.select(F.lit(kind).alias("kind"), "part", none.cast("long").alias("batch"), none.cast("int").alias("home"), "key", "n",
                       none.cast("binary").alias("width"), none.cast("binary").alias("doc")) for kind, t in ((_BIGRAM_TABLE, bigrams), (_WORD_TABLE, words))]
    mixed = asked.where(f"kind <> {_DOC}").unionByName(tables[0]).unionByName(tables[1])
    order = F.when(F.col("kind").isin(_BIGRAM_TABLE, _WORD_TABLE), 0).otherwise(1)
    answers = mixed.repartition(n_parts, "part").sortWithinPartitions(order).mapInArrow(answer, _ANSWER_SQL)
    blank = none.cast("binary")
    heads = asked.where(f"kind = {_DOC}").select("part", "batch", blank.alias("doc"), F.col("width").alias("base"), blank.alias("known"), blank.alias("score"),
                                                 F.col("key").alias("ids"), F.col("n").alias("numbers"), F.col("doc").alias("held"))
    rest = answers.select("part", "batch", "doc", "base", "known", "score", blank.alias("ids"), blank.alias("numbers"), blank.alias("held"))
    return exchange(heads.unionByName(rest), keys, close, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _merge(parts: list, dtype) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, dtype), np.zeros(0, np.int64)
    key, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key)
    return key[order], n[order]
