"""N-gram Jaccard join with skipping by set relations.

Sets share a link when 100 * |intersection| >= percent * |union|. Two linked sets share a
shingle among the first ``n - ceil(percent n / 100) + 1`` of each, in one order of all shingles
(rarest first), so only those are indexed, and only for sets whose first ones are not all their own. An index list is sorted by set size and cut where no
size on one side can reach one on the other; each block names its smallest document as pivot.
Every set of a block is compared with the pivot once. Sets linked to the pivot are one
component and need no test among themselves. What is left is pairs of a set that is not linked to the
pivot; their overlaps are derived from the pivot's: words that a set lacks are taken
off and words that it adds are put on, through the index of the other sets' differences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.blocks import block, chunks, components, exchange, gather, mix, narrow_batches, part_keys, release, runs, split, stored, text_bytes
from textlake.llm.collocations import SCREEN_BITS, _has, _screen
from textlake.llm.words import shingles, word_hashes

#: Sets in one chunk of a star; larger stars are cut.
CHUNK = 512
#: Bytes of text whose shingles a part should hold: smaller parts take more disk, as their blocks compress less.
PART_BYTES = 8 << 20
#: Bytes of text whose shingles are made at once.
TEXT_BYTES = 1 << 20


def _sets(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    return shingles(*word_hashes(*text_bytes(batch.column("text"))), size)


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - -(-n * percent // 100) + 1, 0)


def _sums(value: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    """A sum over each set's shingles that names the set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(salt)), dtype=np.uint64)])
    return (total[at[1:]] - total[at[:-1]]).view(np.int64)


def _profile(docs: DataFrame, size: int) -> DataFrame:
    """Size and two sums that name the set, for every document."""
    def run(batches):
        release()
        for batch in chunks(batches, limit=TEXT_BYTES):
            value, at = _sets(batch, size)
            s1, s2 = _sums(value, at, 0), _sums(value, at, 0xA5A5A5A5A5A5A5A5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(s1), pa.array(s2)], ["doc_id", "n_shingles", "s1", "s2"])
    return docs.mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long")


_GRAMS = pa.schema([("part", pa.int32()), ("gram", pa.binary()), ("df", pa.binary()), ("home", pa.binary()), ("times", pa.binary()),
                    ("number", pa.binary()), ("name", pa.binary()), ("size", pa.binary())])
_GRAMS_SQL = "part int, gram binary, df binary, home binary, times binary, number binary, name binary, size binary"
_EMPTY = np.zeros(0, np.uint8)
#: Sets that share a home: they are told apart by one byte.
HOME = 1 << 8
#: Bits of a shingle that count, those that the part gives included.
GRAM_BITS = 60


def _width(n_parts: int) -> int:
    return min(8, -(-(GRAM_BITS - (n_parts.bit_length() - 1)) // 8))


def _packed(gram: np.ndarray, n_parts: int) -> np.ndarray:
    """The bytes of each shingle that its part does not tell, byte by byte."""
    rest = (gram // np.uint64(n_parts)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(rest[:, :_width(n_parts)].T)


def _unpacked(packed: bytes, part: int, n_parts: int) -> np.ndarray:
    """The shingles of a part, equal where their packed bytes are."""
    some = np.frombuffer(packed, np.uint8).reshape(_width(n_parts), -1).T
    rest = np.zeros((len(some), 8), np.uint8)
    rest[:, :some.shape[1]] = some
    return rest.view("<u8").ravel().astype(np.uint64) * np.uint64(n_parts) + np.uint64(part)


def _runs_of(home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal homes and their lengths, or all homes where that is shorter."""
    at = runs(home)
    return (home[at[:-1]], np.diff(at).astype(np.uint32)) if 3 * (len(at) - 1) < 2 * len(home) else (home, _EMPTY)


def _all_homes(row: dict) -> np.ndarray:
    home, times = np.frombuffer(row["home"], np.int64), np.frombuffer(row["times"], np.uint32)
    return np.repeat(home, times) if len(times) else home


def _homes(name: np.ndarray, copied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(home, number) of each set of a chunk: the name of the first of up to ``HOME`` sets and the place; its own name and 0 if it has copies."""
    home, number = name.copy(), np.zeros(len(name), np.uint8)
    alone = np.flatnonzero(~copied)
    if len(alone):
        place = np.arange(len(alone))
        home[alone] = name[alone[place // HOME * HOME]]
        number[alone] = place % HOME
    return home, number


def _shared_grams(docs: DataFrame, keys: np.ndarray, size: int, copied=None) -> DataFrame:
    """Shingles that more than one set has, with their sets, dealt by the sets' homes, and the names and sizes of the sets.

    A set stands for all documents that have it and goes by its first sum, so that copies cost nothing after the first shuffle.
    That name is as long as a shingle, and where there are many parts each shingle of a set goes to another: only sets that may
    have copies (a bitmap of names, ``copied``; all, without one) take it along. Of the others up to ``HOME`` made together go by
    the name of the first, their home, which a part gets once, and a number of one byte.
    """
    n_parts = len(keys)

    def emit(batches):
        release()
        for batch in chunks(batches, limit=2 * TEXT_BYTES):
            value, at = _sets(batch, size)
            n = np.diff(at)
            name = _sums(value, at, 0)
            named = np.ones(len(name), bool) if copied is None else (n == 0) | _has(copied.value, mix(name.view(np.uint64)))
            home, number = _homes(name, named)
            row = np.repeat(np.arange(len(n)), n)
            order = np.argsort(named[row], kind="stable")
            value, row = value[order], row[order]
            rows = []
            for p, (g, r) in split((value % np.uint64(n_parts)).astype(np.int64), n_parts, value, row):
                rows.append((int(keys[p]), _packed(g, n_parts), _EMPTY, *_runs_of(home[r]), number[r], _EMPTY, _EMPTY))
            some = np.flatnonzero(n > 0)
            for p, (h, k, s, m) in split(home[some] % n_parts, n_parts, home[some], number[some], name[some], n[some].astype(np.int32)):
                rows.append((int(keys[p]), _EMPTY, _EMPTY, h, _EMPTY, k, s, m))
            yield block(rows, _GRAMS)

    def count(batches):
        release()
        held, place = [], {int(k): p for p, k in enumerate(keys)}
        for batch in batches:
            names = np.array([v.as_buffer().size > 0 for v in batch.column("name")], bool)
            if names.any():
                yield batch.filter(pa.array(names))
            for r in batch.filter(pa.array(~names)).to_pylist():
                held.append((_unpacked(r["gram"], place[r["part"]], n_parts), _all_homes(r), np.frombuffer(r["number"], np.uint8)))
        gram, home, number = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, t) for t in (np.uint64, np.int64, np.uint8))
        held.clear()
        order = np.argsort(gram, kind="stable")
        df = np.diff(runs(gram[order]))
        order = order[np.repeat(df > 1, df)]
        order = order[np.lexsort((number[order], home[order], gram[order]))]
        gram, home, number = gram[order], home[order], number[order]
        once = np.ones(len(gram), bool)
        once[1:] = (gram[1:] != gram[:-1]) | (home[1:] != home[:-1]) | (number[1:] != number[:-1])
        gram, home, number = gram[once], home[once], number[once]
        df = np.diff(runs(gram))
        more = np.repeat(df > 1, df)
        gram, home, number = gram[more], home[more], number[more]
        df = np.minimum(np.repeat(df[df > 1], df[df > 1]), 65535).astype(np.uint16)
        order = np.lexsort((number, home))
        gram, df, home, number = gram[order], df[order], home[order], number[order]
        rows = []
        for p, (g, d, h, k) in split(home % n_parts, n_parts, gram, df, home, number):
            rows.append((int(keys[p]), g, d, *_runs_of(h), k, _EMPTY, _EMPTY))
        yield block(rows, _GRAMS)
    return exchange(docs.mapInArrow(emit, _GRAMS_SQL), keys, count, _GRAMS_SQL)


def _named(batches) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All (gram, df, set's name, set's size) of a part of shared shingles."""
    held, known = [], []
    for batch in batches:
        for r in batch.to_pylist():
            home, number = _all_homes(r), np.frombuffer(r["number"], np.uint8)
            if r["name"]:
                known.append((home, number, np.frombuffer(r["name"], np.int64), np.frombuffer(r["size"], np.int32)))
            else:
                held.append((np.frombuffer(r["gram"], np.uint64), np.frombuffer(r["df"], np.uint16), home, number))
    if not held:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int32)
    home, number, name, size = (np.concatenate(x) for x in zip(*known))
    order = np.lexsort((number, home))
    home, number, name, size = home[order], number[order], name[order], size[order]
    new = np.ones(len(home), bool)
    new[1:] = (home[1:] != home[:-1]) | (number[1:] != number[:-1])
    home, number, name, size = home[new], number[new], name[new], size[new]
    gram, df, whose, which = (np.concatenate(x) for x in zip(*held))
    # the numbers of a home are 0, 1, .. without a gap
    at = np.searchsorted(home, whose) + which
    return gram, df, name[at], size[at]


def _candidates(shared: DataFrame, keys: np.ndarray, percent: int) -> DataFrame:
    """Sets (``doc_id``, the set's first sum, ``n, grams``) whose prefix reaches a shared shingle, and index blocks of those prefixes (``part``).

    Shingles of one set come first in the order, so a set with enough of them is linked with nothing.
    ``grams`` holds the shared shingles only: no overlap has others.
    """
    n_parts = len(keys)
    schema = pa.schema([("part", pa.int32()), ("gram", pa.binary()), ("doc", pa.binary()), ("size", pa.binary()),
                        ("doc_id", pa.int64()), ("n", pa.int64()), ("grams", pa.binary())])

    def run(batches):
        release()
        gram, df, doc, n = _named(batches)
        order = np.lexsort((n, doc))
        ends = runs(doc[order])
        counts, size = np.diff(ends), n[order][ends[:-1]].astype(np.int64)
        fine = counts >= size - _prefix(size, percent) + 1
        order = order[np.repeat(fine, counts)]
        gram, df, doc, n = gram[order], df[order], doc[order], n[order].astype(np.int64)
        order = np.lexsort((gram, df, doc))
        gram, doc, n = gram[order], doc[order], n[order]
        ends = runs(doc)
        counts = np.diff(ends)
        size = n[ends[:-1]] if len(n) else n
        place = np.arange(len(doc)) - np.repeat(ends[:-1], counts)
        use = place < np.repeat(_prefix(size, percent) - (size - counts), counts)
        part = (mix(gram[use]) % np.uint64(n_parts)).astype(np.int64)
        yield block([(int(keys[p]), g, d, m, None, None, None) for p, (g, d, m) in split(part, n_parts, gram[use], doc[use], n[use].astype(np.int32))], schema)
        for lo in range(0, len(counts), 500):
            rows = range(lo, min(lo + 500, len(counts)))
            yield block([(None, None, None, None, int(doc[ends[i]]), int(size[i]), np.unique(gram[ends[i]:ends[i + 1]])) for i in rows], schema)
    return exchange(shared, keys, run, "part int, gram binary, doc binary, size binary, doc_id long, n long, grams binary")


def _stars(index: DataFrame, keys: np.ndarray, percent: int) -> DataFrame:
    """Distinct (pivot, doc_id) of all blocks of all index lists with more than one document."""
    def find(batches):
        release()
        gram, doc, n = gather(batches, ("gram", np.uint64), ("doc", np.int64), ("size", np.int32))
        order = np.lexsort((doc, n, gram))
        gram, doc, n = gram[order], doc[order], n[order].astype(np.int64)
        # a block ends with its list, or where the next larger set is too large for all before it
        cut = np.ones(len(gram), bool)
        cut[1:] = (gram[1:] != gram[:-1]) | (n[:-1] * 100 < n[1:] * percent)
        starts = np.flatnonzero(cut)
        if len(starts):
            pivot = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(doc))))
            other = pivot != doc
            pairs = np.unique(np.stack([pivot[other], doc[other]], 1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
            for i in range(0, len(pairs), 100_000):
                some = pairs[i:i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(some[:, 0].copy()), pa.array(some[:, 1].copy())], ["pivot", "doc_id"])
    return exchange(index, keys, find, "pivot long, doc_id long").distinct()


def _linked(overlap, a, b, percent: int):
    return 100 * overlap >= percent * (a + b - overlap)


def _groups(batches, names: list[str]):
    """Rows of a partition sorted by the named columns, one group at a time: (key, batch)."""
    held, key = [], None
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in names]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        bounds = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(bounds, bounds[1:]):
            if lo == hi:
                continue
            this = tuple(int(c[lo]) for c in columns)
            if key is not None and this != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = this
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield key, pa.Table.from_batches(held)


def _blob(table: pa.Table, name: str) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column(name)]


def _with_pivots(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """Star rows (``pivot``, ``chunk``, ``doc_id``, ``grams``), the pivot's own row in every chunk."""
    spread = F.pmod(F.xxhash64("doc_id"), F.col("chunks"))
    sizes = stars.groupBy("pivot").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("chunks"))
    members = stars.join(sizes, "pivot").select("pivot", spread.alias("chunk"), "doc_id")
    pivots = sizes.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.col("pivot").alias("doc_id"))
    return members.union(pivots).join(sets, "doc_id").select("pivot", "chunk", "doc_id", "n", "grams")


def _first_links(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Overlap of every star member with its pivot: ``pivot, doc_id, linked``."""
    def run(batches):
        release()
        for (pivot, _), table in _groups(batches, ["pivot", "chunk"]):
            ids, grams = table.column("doc_id").to_numpy(), _blob(table, "grams")
            at = int(np.flatnonzero(ids == pivot)[0])
            held, size = np.array([len(g) for g in grams]), table.column("n").to_numpy()
            inside = np.isin(np.concatenate(grams), grams[at])
            overlap = np.add.reduceat(inside, np.cumsum(held) - held).astype(np.int64)
            keep = ids != pivot
            yield pa.RecordBatch.from_arrays([pa.array(np.full(keep.sum(), pivot)), pa.array(ids[keep]), pa.array(_linked(overlap, size, size[at], percent)[keep])],
                                             ["pivot", "doc_id", "linked"])
    rows = _with_pivots(stars, sets).repartition("pivot", "chunk").sortWithinPartitions("pivot", "chunk")
    return rows.mapInArrow(run, "pivot long, doc_id long, linked boolean")


def derived_links(pivot: np.ndarray, left: list[np.ndarray], right: list[np.ndarray], size_l: np.ndarray, size_r: np.ndarray,
                  percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two lists of sets, from their overlaps with the pivot and their differences to it.

    |x and y| = |p and y| - |(p without x) and y| + |(x without p) and y|: the first is known, the
    other two are counted in an index of the right sets by shingle.
    """
    flat, owner = np.concatenate(right), np.repeat(np.arange(len(right)), [len(g) for g in right])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]

    def count(grams: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(flat, grams), np.searchsorted(flat, grams, side="right")
        width = hi - lo
        at = np.arange(width.sum()) + np.repeat(lo - (np.cumsum(width) - width), width)
        return np.bincount(owner[at], minlength=len(right))
    base = count(pivot)
    xs, ys = [], []
    for i, x in enumerate(left):
        overlap = base - count(np.setdiff1d(pivot, x, assume_unique=True)) + count(np.setdiff1d(x, pivot, assume_unique=True))
        hit = np.flatnonzero(_linked(overlap, size_l[i], size_r, percent))
        xs.append(np.full(len(hit), i))
        ys.append(hit)
    return np.concatenate(xs), np.concatenate(ys)


def _rest_links(stars: DataFrame, first: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between star members of different components so far; one per set and component.

    ``stars`` has ``root``, the component of the member, ``home``, that of the pivot. Members that are in
    the pivot's component are compared with the others only. A star is cut into chunks of ``CHUNK`` members
    and a task holds one chunk of each side.
    """
    away = F.col("root") != F.col("home")
    open_stars = stars.groupBy("pivot").agg(F.max(away.cast("int")).alias("any"), F.count("*").alias("n")).where("any = 1")
    chunks_of = open_stars.select("pivot", F.ceil((F.col("n") + 1) / CHUNK).cast("long").alias("chunks"))
    members = (stars.join(chunks_of, "pivot")
               .select("pivot", "chunks", "doc_id", "root", away.alias("away"), F.pmod(F.xxhash64("doc_id"), F.col("chunks")).alias("own")))
    all_chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    left = members.where("away").select("pivot", F.col("own").alias("i"), all_chunks.alias("j"), "doc_id", "root", F.lit(0).alias("side"))
    right = (members.select("pivot", "chunks", F.col("own").alias("j"), all_chunks.alias("i"), "doc_id", "root")
             .select("pivot", "i", "j", "doc_id", "root", F.lit(1).alias("side")))
    pivots = (chunks_of.select("pivot", "chunks", all_chunks.alias("i"))
              .select("pivot", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("j"),
                      F.col("pivot").alias("doc_id"), F.lit(-1).cast("long").alias("root"), F.lit(2).alias("side")))

    def run(batches):
        release()
        for (pivot, _, _), table in _groups(batches, ["pivot", "i", "j"]):
            ids, root, side, size = (table.column(c).to_numpy() for c in ("doc_id", "root", "side", "n"))
            grams = _blob(table, "grams")
            l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(l) or not len(r):
                continue
            middle = grams[int(np.flatnonzero(side == 2)[0])]
            x, y = derived_links(middle, [grams[k] for k in l], [grams[k] for k in r], size[l], size[r], percent)
            a, b, to = ids[l[x]], ids[r[y]], root[r[y]]
            other = root[l[x]] != to
            a, b, to = a[other], b[other], to[other]
            _, pick = np.unique(np.stack([a, to], 1), axis=0, return_index=True) if len(a) else (None, np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(a[pick]), pa.array(b[pick])], ["a", "b"])
    rows = (left.union(right).union(pivots).join(sets, "doc_id")
            .repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j"))
    return rows.mapInArrow(run, "a long, b long")


def _set_names(batches):
    for batch in batches:
        yield mix(batch.column("s1").to_numpy().view(np.uint64))


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document: the smallest doc_id that links reach.

    Sets are the distinct ``size``-word shingles of the lower-cased whole text; fewer words are one shingle.
    Null or empty texts have no shingles and are linked with nothing. A doc_id names one text: rows that repeat it
    stay rows and get its component. A null doc_id is linked with nothing and has no component.
    """
    spark = docs.sparkSession
    narrow_batches(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = stored(_profile(slim, size), "sets")
    full = own.where("n_shingles > 0 and doc_id is not null")
    # stored, so that the join can split a set that very many documents have
    same = stored(full.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep")), "same")
    copies = stored(full.join(same, ["s1", "s2", "n_shingles"]).select("doc_id", "rep").distinct(), "copies")
    keys = part_keys(spark, docs, PART_BYTES)
    # sums of sets that more than one row has, in a bitmap of fixed size; a set that shares a bit with one of them is only named in vain
    copied = spark.sparkContext.broadcast(_screen(full.select("s1"), keys, 2, SCREEN_BITS, _set_names))
    shared = _shared_grams(slim.where("doc_id is not null"), keys, size, copied)
    found = stored(_candidates(shared, keys, percent), "candidates")
    stars = stored(_stars(found.where("part is not null").select("part", "gram", "doc", "size"), keys, percent), "stars")
    wanted = stars.select("doc_id").union(stars.select("pivot")).distinct()
    sets = stored(found.where("part is null").select("doc_id", "n", "grams").join(wanted, "doc_id"), "grams")
    first = stored(_first_links(stars, sets, percent), "links")
    links = first.where("linked").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b"))
    same_id = copies.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    roots = components(links)
    named = (stars.join(roots.select(F.col("v").alias("doc_id"), "root"), "doc_id", "left")
             .join(roots.select(F.col("v").alias("pivot"), F.col("root").alias("home")), "pivot", "left")
             .select("pivot", "doc_id", F.coalesce("root", "doc_id").alias("root"), F.coalesce("home", "pivot").alias("home")))
    rest = stored(_rest_links(named, first, sets, percent), "rest")
    # up to here sets are linked; each is named by its smallest document from here on
    linked = roots.select(F.col("v").alias("a"), F.col("root").alias("b")).union(rest)
    for end in ("a", "b"):
        linked = linked.join(same.select(F.col("s1").alias(end), F.col("rep").alias(f"rep_{end}")), end)
    final = components(linked.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).union(same_id))
    return (own.join(final.select(F.col("v").alias("doc_id"), "root"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")))
