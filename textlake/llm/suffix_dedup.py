"""Removal of repeated passages: longest-previous-factor arrays over suffixes.

A byte goes when a string of ``length`` bytes that covers it also starts in a document with a smaller
id. Suffix arrays are built where suffixes can match, not over the whole corpus:

1. Every window of ``length`` bytes chooses an anchor, its k-gram of least hash (leftmost on ties), so equal
   windows have equal anchors at equal places. About one byte in 17 starts an anchor. Anchors
   meet by hash; one document's anchors go no further.
2. The context of an anchor is all bytes of windows that can hold it. Where the whole context stands in an
   earlier document, all its windows do. Only the first document of each context is compared further.
3. The differing contexts of an anchor form the suffix array of step 3: prefix doubling sorts the suffixes,
   and a suffix whose previous smaller document shares ``length`` bytes (LPF of at least ``length``)
   is a later copy. Contexts of a very frequent anchor meet by the bytes on one side of it; where these are very frequent
   too, single suffixes travel, keyed by their own bytes.
4. Documents take the places found and drop the covered bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from textlake.llm.blocks import block, chunks, exchange, gather, mix, narrow_batches, part_keys, read, release, runs, split, stored, text_bytes
from textlake.llm.words import _BACK, _BYTE, _STEP, powers

GRAM = 18
#: Contexts of an anchor that are compared together: with more they are dealt by the bytes on one side of it, and with more than
#: this of the same side they send single suffixes.
HOT = 256
#: Suffixes that are sorted together.
SORTED = 1 << 18
#: Bytes of text that a task works on at a time.
PIECE = 1 << 20
_U32, _U20, _U10, _MASK = np.uint64(32), np.uint64(20), np.uint64(10), np.uint64(1023)


class _Sums:
    """Hashes of any span of a buffer from prefix sums."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(_STEP, len(data)), dtype=np.uint64, out=self.sums[1:])
        self.back = powers(_BACK, len(data) + 1)

    def span(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.back[lo] + (hi - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def grams(self, size: int) -> np.ndarray:
        return mix((self.sums[size:] - self.sums[:-size]) * self.back[:len(self.sums) - size])


def anchors(data: np.ndarray, at: np.ndarray, sums: _Sums, length: int) -> np.ndarray:
    """Places of the anchors of all windows that lie inside one text."""
    if len(data) < length:
        return np.zeros(0, np.int64)
    key = (sums.grams(GRAM) >> _U32 << _U32) | np.arange(len(data) - GRAM + 1, dtype=np.uint64)
    width, have = length - GRAM + 1, 1
    while have * 2 <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if have < width:
        key = np.minimum(key[:len(key) - (width - have)], key[width - have:])
    ends = np.repeat(at[1:], np.diff(at))[:len(key)]
    best = key[np.arange(len(key)) + length <= ends]
    chosen = np.zeros(len(data), bool)
    chosen[(best & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
    return np.flatnonzero(chosen)


def suffix_ranks(data: np.ndarray, cap: int) -> np.ndarray:
    """Rank of every suffix by its first ``cap`` bytes (at least 8), by prefix doubling."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(cap, np.uint8)]).astype(np.uint64)
    first = np.zeros(n, np.uint64)
    for k in range(8):
        first = (first << np.uint64(8)) | padded[k:n + k]
    rank = np.unique(first, return_inverse=True)[1].astype(np.uint64)
    have = 8
    while have < cap:
        step = min(have, cap - have)
        following = np.concatenate([rank[step:] + np.uint64(1), np.zeros(step, np.uint64)])
        rank = np.unique(rank * np.uint64(n + 2) + following, return_inverse=True)[1].astype(np.uint64)
        have += step
    return rank.astype(np.int64)


def ranks_of(data: np.ndarray, suffix: np.ndarray, cap: int) -> np.ndarray:
    """Rank of each given suffix among them by its first ``cap`` bytes, all of which ``data`` holds."""
    first = np.zeros((len(suffix), -(-cap // 8) * 8), np.uint8)
    first[:, :cap] = sliding_window_view(data, cap)[suffix]
    words = first.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    new = np.zeros(len(suffix), np.int64)
    new[1:] = (words[order][1:] != words[order][:-1]).any(axis=1)
    rank = np.empty(len(suffix), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def later_copies(ranks: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether the longest previous factor of each suffix reaches the length the ranks were cut at.

    In suffix order, ties by document, the suffixes that share that length are one run; a
    suffix's previous smaller document is the head of its run, unless the head is its own.
    """
    order = np.lexsort((docs, ranks))
    starts = runs(ranks[order])
    head = np.repeat(docs[order][starts[:-1]], np.diff(starts))
    out = np.zeros(len(docs), bool)
    out[order] = head < docs[order]
    return out


def meeting(data: np.ndarray, suffix: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """Whether the hash of the first ``length`` bytes of each suffix is that of another document's too."""
    if len(suffix) == 0:
        return np.zeros(0, bool)
    hashes = _Sums(data).span(suffix, suffix + length)
    order = np.argsort(hashes)
    starts = runs(hashes[order])
    of = docs[order]
    out = np.zeros(len(docs), bool)
    out[order] = np.repeat(np.minimum.reduceat(of, starts[:-1]) < np.maximum.reduceat(of, starts[:-1]), np.diff(starts))
    return out


def _doc_part(doc, n: int):
    return doc % n


def _slices(batch_docs: np.ndarray, batch_tags: np.ndarray, docs: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the batch, entry) for all entries of the batch's documents; entries are sorted by document."""
    lo, hi = np.searchsorted(docs, batch_docs), np.searchsorted(docs, batch_docs, side="right")
    width = hi - lo
    row = np.repeat(np.arange(len(batch_docs)), width)
    entry = np.arange(width.sum()) + np.repeat(lo - (np.cumsum(width) - width), width)
    same = tags[entry] == batch_tags[row]
    return row[same], entry[same]


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("doc_id").fill_null(-(1 << 63)).to_numpy(), batch.column("tag").to_numpy().astype(np.uint32)


_ENTRY = [("kind", pa.int32()), ("part", pa.int32()), ("doc", pa.binary()), ("mark", pa.binary()), ("place", pa.binary()), ("gram", pa.binary())]
_ENTRY_SQL = "kind int, part int, doc binary, mark binary, place binary, gram binary"
_COPY, _CHECK, _HOT, _WINDOW = 0, 1, 2, 3


def _entries(kind: int, keys: np.ndarray, doc, mark, place, gram=None) -> list[tuple]:
    """Rows of found places, dealt by document."""
    n = len(keys)
    gram = np.zeros(0, np.uint64) if gram is None else gram
    columns = [doc, mark, place] + ([gram] if len(gram) else [])
    part = np.asarray(_doc_part(doc, n), np.int64)
    return [(kind, int(keys[p]), *cut, *([] if len(gram) else [np.zeros(0, np.uint64)])) for p, cut in split(part, n, *columns)]


def _planes(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low and high halves: the high ones are runs of equal values, which compress."""
    return (place & 0xFFFF).astype(np.uint16), (place >> 16).astype(np.uint16)


def _find_repeats(docs: DataFrame, keys: np.ndarray, length: int) -> DataFrame:
    """Places of anchors whose context is a copy (kind 0) or differs between documents (1; 2 for frequent anchors)."""
    n_parts, reach = len(keys), length - GRAM
    half = -(-reach // 2)
    schema = pa.schema([("part", pa.int32()), ("gram", pa.binary()), ("context", pa.binary()), ("doc", pa.binary()), ("mark", pa.binary()), ("place", pa.binary()), ("far", pa.binary())])

    def emit(batches):
        release()
        for batch in chunks(batches, limit=PIECE):
            data, at = text_bytes(batch.column("text"))
            sums = _Sums(data)
            p = anchors(data, at, sums, length)
            row = np.searchsorted(at, p, side="right") - 1
            lo, hi = np.maximum(at[row], p - reach), np.minimum(at[row + 1], p + length)
            gram = sums.span(p, p + GRAM)
            # anchors of one part that agree in 32 more bits are only compared in vain
            short = (gram // np.uint64(n_parts)).astype(np.uint32)
            near = [sums.span(np.maximum(at[row], p - half), p + GRAM), sums.span(p, np.minimum(at[row + 1], p + GRAM + half))]
            context = mix(sums.span(lo, hi) + (p - lo).astype(np.uint64)) << _U20 | (near[0] & _MASK) << _U10 | near[1] & _MASK
            ids, tags = _ids(batch)
            part = (gram % np.uint64(n_parts)).astype(np.int64)
            yield block([(int(keys[k]), *cut) for k, cut in split(part, n_parts, short, context, ids[row], tags[row], *_planes(p - at[row]))], schema)

    def resolve(batches):
        release()
        gram, context, doc, mark, low, far = gather(batches, ("gram", np.uint32), ("context", np.uint64), ("doc", np.int64), ("mark", np.uint32), ("place", np.uint16), ("far", np.uint16))
        place = (far.astype(np.int32) << 16) | low
        order = np.argsort(gram, kind="stable")
        starts = runs(gram[order])
        if len(gram) == 0:
            return
        sorted_doc = doc[order]
        many = np.repeat(np.minimum.reduceat(sorted_doc, starts[:-1]) < np.maximum.reduceat(sorted_doc, starts[:-1]), np.diff(starts))
        order = order[many]
        gram, context, doc, mark, place = gram[order], context[order], doc[order], mark[order], place[order]
        order = np.lexsort((doc, context, gram))
        gram, context, doc, mark, place = gram[order], context[order], doc[order], mark[order], place[order]
        if len(gram) == 0:
            return
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])
        starts = np.append(np.flatnonzero(new), len(gram))
        first = np.repeat(doc[starts[:-1]], np.diff(starts))
        copy = doc > first
        heads, outer = starts[:-1], runs(gram[starts[:-1]])
        contexts = np.diff(outer)
        # a shared window holds half of the reach on one side, so one of the two near hashes is shared too
        owner = np.repeat(np.arange(len(contexts)), contexts)
        group, times, shared = [], [], np.zeros(len(heads), bool)
        for side in (context[heads] >> _U10 & _MASK, context[heads] & _MASK):
            _, back, count = np.unique(owner.astype(np.uint64) << _U10 | side, return_inverse=True, return_counts=True)
            shared |= count[back] > 1
            group.append(back)
            times.append(count)
        rivals = np.add.reduceat(shared.astype(np.int64), outer[:-1])
        apart = np.minimum.reduceat(doc[heads], outer[:-1]) < np.maximum.reduceat(doc[heads], outer[:-1])
        number = np.where(shared & apart[owner], rivals[owner], 0)
        rows = _entries(_COPY, keys, doc[copy], mark[copy], place[copy])
        # what meets: contexts of an anchor or, where it has too many, those with the same bytes on one side of it
        meet = [(_CHECK, (number > 1) & (number <= HOT), mix(gram[heads].astype(np.uint64)))]
        for k, (back, count) in enumerate(zip(group, times)):
            lowest, highest = np.full(len(count), np.iinfo(np.int64).max), np.full(len(count), np.iinfo(np.int64).min)
            np.minimum.at(lowest, back, doc[heads])
            np.maximum.at(highest, back, doc[heads])
            several = (number > HOT) & (lowest < highest)[back]
            bits = context[heads] >> (_U10 if k == 0 else np.uint64(0)) & _MASK
            key = mix(gram[heads].astype(np.uint64) << np.uint64(11) | bits << np.uint64(1) | np.uint64(k))
            meet += [(_CHECK, several & (count[back] <= HOT), key), (_HOT, several & (count[back] > HOT), key)]
        position = np.repeat(np.arange(len(heads)), np.diff(starts))
        for kind, wanted, key in meet:
            pick = np.flatnonzero(~copy & wanted[position])
            rows += _entries(kind, keys, doc[pick], mark[pick], place[pick], key[position[pick]])
        yield block(rows, pa.schema(_ENTRY))
    blocks = docs.mapInArrow(emit, "part int, gram binary, context binary, doc binary, mark binary, place binary, far binary")
    return exchange(blocks, keys, resolve, _ENTRY_SQL)


def _with_docs(docs: DataFrame, entries: DataFrame, keys: np.ndarray) -> DataFrame:
    """Entries, then documents, of the same part in the same partition."""
    own = F.element_at(F.lit(keys.tolist()), (F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(len(keys))) + 1).cast("int"))
    blank = F.lit(None).cast("binary")
    right = _squeezed(docs).select(F.lit(9).alias("kind"), own.alias("part"), blank.alias("doc"), blank.alias("mark"), blank.alias("place"), blank.alias("gram"), "doc_id", "tag", "text", "rest")
    left = entries.select("kind", "part", "doc", "mark", "place", "gram", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("tag"), blank.alias("text"), F.lit(None).cast(docs.schema["rest"].dataType).alias("rest"))
    return left.unionByName(right).repartition(len(keys), "part").sortWithinPartitions("kind")


def _squeezed(docs: DataFrame) -> DataFrame:
    """The same rows with ``text`` compressed: texts are shuffled twice, and take most of the disk."""
    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in chunks(batches):
            at = batch.schema.get_field_index("text")
            text = pa.array([squeeze(t.as_buffer()) for t in batch.column(at)], pa.binary())
            yield batch.set_column(at, "text", text)
    fields = [StructField("text", BinaryType()) if f.name == "text" else f for f in docs.schema]
    return docs.mapInArrow(run, StructType(fields))


def _restored(batch: pa.RecordBatch) -> pa.RecordBatch:
    expand = zstandard.ZstdDecompressor().decompress
    at = batch.schema.get_field_index("text")
    return batch.set_column(at, "text", pa.array([expand(t.as_buffer()) for t in batch.column(at)], pa.binary()).cast(pa.string()))


def _entries_then_docs(batches, kinds: tuple[int, ...]):
    """First the sorted entries of each kind, then batches of documents."""
    held = {k: [[], [], [], []] for k in kinds}
    types = (("doc", np.int64), ("mark", np.uint32), ("place", np.int32), ("gram", np.uint64))
    done = False
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        for k in kinds:
            rows = np.flatnonzero(kind == k)
            if len(rows):
                some = batch.take(pa.array(rows))
                for out, (name, dtype) in zip(held[k], types):
                    out.append(read(some.column(name), dtype))
        rows = np.flatnonzero(kind == 9)
        if len(rows):
            if not done:
                yield {k: _sorted([np.concatenate(x) if x else np.zeros(0, t) for x, (_, t) in zip(held[k], types)]) for k in kinds}
                done = True
            yield from chunks([_restored(batch.slice(int(rows[0])))], limit=PIECE)


def _sorted(columns: list[np.ndarray]) -> list[np.ndarray]:
    order = np.argsort(columns[0], kind="stable")
    return [c[order] if len(c) == len(order) else c for c in columns]


def _check_contexts(docs: DataFrame, entries: DataFrame, keys: np.ndarray, length: int) -> DataFrame:
    """Places (kind 3) of windows in differing contexts that start in an earlier document too."""
    n_parts, reach = len(keys), length - GRAM
    wide = reach + length
    columns = [("part", pa.int32()), ("wide", pa.bool_()), ("bytes", pa.binary()), ("doc", pa.binary()), ("mark", pa.binary()), ("place", pa.binary()), ("left", pa.binary()), ("right", pa.binary())]
    sql = "part int, wide boolean, bytes binary, doc binary, mark binary, place binary, left binary, right binary"

    def cut(batches):
        release()
        stream = _entries_then_docs(batches, (_CHECK, _HOT))
        found = next(stream, None)
        for batch in stream:
            data, at = text_bytes(batch.column("text"))
            padded = np.concatenate([np.zeros(reach, np.uint8), data, np.zeros(length, np.uint8)])
            ids, tags = _ids(batch)
            rows = []
            for kind in (_CHECK, _HOT):
                doc, mark, place, gram = found[kind]
                row, entry = _slices(ids, tags, doc, mark)
                p = at[row] + place[entry]
                left, right = np.minimum(place[entry], reach), np.minimum(at[row + 1] - p, length)
                bytes_ = sliding_window_view(padded, wide)[p]
                if kind == _CHECK:
                    part = (gram[entry] % np.uint64(n_parts)).astype(np.int64)
                    items = [bytes_, ids[row], tags[row], place[entry], left.astype(np.uint8), right.astype(np.uint8)]
                else:
                    start = np.arange(reach + 1)
                    inside = (start >= reach - left[:, None]) & (start + length <= reach + right[:, None])
                    which, start = np.nonzero(inside)
                    window = sliding_window_view(bytes_, length, axis=1)[which, start]
                    d, first = ids[row][which], place[entry][which] + start - reach
                    hashes = _row_hash(window)
                    # equal windows of one batch meet here; only the smallest document goes on
                    order = np.lexsort((d, hashes))
                    head = np.ones(len(order), bool)
                    head[1:] = (hashes[order][1:] != hashes[order][:-1])
                    least = np.repeat(d[order][head], np.diff(np.append(np.flatnonzero(head), len(order)))) if len(order) else d[order]
                    later = d[order] > least
                    rows += [(p_, None, None, c[0], c[1], c[2], None, None) for p_, c in _as_copies(d[order][later], tags[row][which][order][later], first[order][later], keys)]
                    pick = order[~later]
                    part = (hashes[pick] % np.uint64(n_parts)).astype(np.int64)
                    items = [window[pick], d[pick], tags[row][which][pick], first[pick].astype(np.int32), np.zeros(len(pick), np.uint8), np.zeros(len(pick), np.uint8)]
                rows += [(int(keys[q]), kind == _CHECK, c[0].ravel(), *c[1:]) for q, c in split(part, n_parts, *items)]
            yield block(rows, pa.schema(columns))

    def compare(batches):
        release()
        held = {True: [], False: []}
        out = []
        for batch in batches:
            flag = batch.column("wide").to_pylist()
            for w in (True, False, None):
                rows = [i for i, f in enumerate(flag) if f is w]
                if not rows:
                    continue
                some = batch if len(rows) == batch.num_rows else batch.take(pa.array(rows))
                got = [read(some.column(n), t) for n, t in (("bytes", np.uint8), ("doc", np.int64), ("mark", np.uint32), ("place", np.int32), ("left", np.uint8), ("right", np.uint8))]
                if w is None:
                    out.append((got[1], got[2], got[3]))
                else:
                    held[w].append(got)
        for w, parts in held.items():
            if not parts:
                continue
            columns_ = [np.concatenate(x) for x in zip(*parts)]
            parts.clear()
            size = wide if w else length
            rows = columns_[0].reshape(-1, size)
            # suffixes of different anchors share no window, so the part is sorted in pieces of whole anchors
            pieces = 1 + rows.size // SORTED
            release()
            own = _row_hash(rows[:, reach:reach + GRAM] if w else rows) % np.uint64(pieces)
            for _, (pick,) in split(own.astype(np.int64), pieces, np.arange(len(rows))):
                some, doc, mark, place, left, right = (c[pick] for c in (rows, *columns_[1:]))
                if w:
                    start = np.arange(reach + 1)
                    which, start = np.nonzero((start >= reach - left[:, None].astype(np.int64)) & (start + length <= reach + right[:, None].astype(np.int64)))
                    suffix, first = which * wide + start, place[which] + start - reach
                else:
                    which = np.arange(len(doc))
                    suffix, first = which * length, place
                meets = meeting(some.ravel(), suffix, doc[which], length)
                if not meets.any():
                    continue
                # only suffixes whose first bytes meet are sorted
                which, suffix, first = which[meets], suffix[meets], first[meets]
                later = later_copies(ranks_of(some.ravel(), suffix, length), doc[which])
                out.append((doc[which][later], mark[which][later], first[later].astype(np.int32)))
        if out:
            yield block(_entries(_WINDOW, keys, *[np.concatenate(x) for x in zip(*out)]), pa.schema(_ENTRY))
    blocks = _with_docs(docs, entries.where(f"kind in ({_CHECK}, {_HOT})"), keys).mapInArrow(cut, sql)
    return exchange(blocks, keys, compare, _ENTRY_SQL)


def _as_copies(doc, mark, first, keys):
    for row in _entries(_WINDOW, keys, doc, mark, first.astype(np.int32)):
        yield row[1], row[2:5]


def _row_hash(rows: np.ndarray) -> np.ndarray:
    """Hash of each row of bytes."""
    out = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        out = out * np.uint64(_STEP) + _BYTE[rows[:, k]]
    return mix(out)


def removed_spans(docs: DataFrame, length: int = 50, keep: bool = False) -> DataFrame:
    """What is left of every whole text: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    ``n_spans`` counts maximal runs of removed bytes; strings are judged on the input, and matches of a
    document with itself do not count. Null text is empty; a text shorter than ``length`` bytes keeps all; a null
    doc_id neither loses bytes nor is an earlier document. Rows that repeat a doc_id are no earlier documents to each
    other. With ``keep``, the columns of ``docs`` come back with ``text`` cut down to what is left (bytes of a cut
    character are left out), whatever other columns there are.
    """
    spark = docs.sparkSession
    narrow_batches(spark, 200)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(F.encode(text, "UTF-8")).alias("tag"), text.alias("text"),
                       (F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]) if keep else F.lit(0)).alias("rest"))
    keys = part_keys(spark, slim)
    known = slim.where("doc_id is not null").withColumn("rest", F.lit(0))
    entries = stored(_find_repeats(known, keys, length), "repeats")
    windows = stored(_check_contexts(known, entries, keys, length), "windows")
    reach = length - GRAM

    def finish(batches):
        release()
        stream = _entries_then_docs(batches, (_COPY, _WINDOW))
        found = next(stream, None)
        for batch in stream:
            data, at = text_bytes(batch.column("text"))
            ids, tags = _ids(batch)
            edge = np.zeros(len(data) + 1, np.int32)
            for kind in (_COPY, _WINDOW):
                doc, mark, place, _ = found[kind]
                row, entry = _slices(ids, tags, doc, mark)
                row, entry = row[ids[row] > -(1 << 63)], entry[ids[row] > -(1 << 63)]
                p = at[row] + place[entry]
                lo = np.maximum(at[row], p - reach) if kind == _COPY else p
                np.add.at(edge, lo, 1)
                np.add.at(edge, np.minimum(at[row + 1], p + length), -1)
            gone = np.cumsum(edge[:-1]) > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = at[:-1][at[:-1] < len(data)]
            begins[inner] = gone[inner]
            removed, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, begins))
            left = data[~gone]
            ends = at - removed[at]
            kept = [left[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            columns = [batch.column("doc_id"), pa.array(np.diff(at)), pa.array(np.diff(removed[at])), pa.array(np.diff(spans[at]))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans"]
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())], ["rest", "kept"])
            else:
                yield pa.RecordBatch.from_arrays([*columns, pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], [*names, "kept_sha256"])
    rows = _with_docs(slim, entries.where(f"kind = {_COPY}").unionByName(windows), keys)
    if keep:
        left = rows.mapInArrow(finish, StructType([slim.schema["rest"], StructField("kept", StringType())]))
        return left.select(*[F.col("kept").alias("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns])
    return rows.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
