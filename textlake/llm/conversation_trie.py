"""Prefix trie of conversations, screened by a count-min sketch of prefix digests.

A turn counts as (role, text); a prefix as the sum of 32-bit lanes of hash(place, turn) over its turns, a
digest of 128 bits that running sums give without a task that holds a conversation. Texts are read once and
never shuffled. The sketch bounds from above how many conversations start with a prefix: an estimate of
one proves that no other does, and then none shares what follows, so such nodes are written where their
rows stand. The other prefixes alone are grouped by digest, exactly.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.blocks import mix, narrow_batches, release, stored

#: Cells of one row of the sketch and rows of it: 8 MB, whatever the input; a full sketch screens less, the result is the same.
CELLS, ROWS = 1 << 22, 2
#: Turns of a conversation that one task numbers or sums up at once.
RUN = 4096
#: Bytes of decimal ids in one piece of a list that is hashed.
PIECE = 1 << 16
_EMPTY = hashlib.sha256(b"").hexdigest()
_LANES = ["s1", "s2", "s3", "s4"]
_WORD = 0xFFFFFFFF


def _numbered(turns: DataFrame) -> DataFrame:
    """Add ``i``, the place of a turn in its conversation from 1, by turn (null first), role and text.

    Turns are numbered within spans of ``RUN`` turn values and shifted by what the spans before hold, so a
    conversation with most of all turns is spread over tasks. Rows that share a turn value are ordered by digests of
    equal order: ``tie`` ranks the distinct (role, text) of such rows.
    """
    span = F.coalesce(F.floor(F.col("turn") / RUN).cast("long"), F.lit(-(1 << 62)))
    turns = turns.withColumn("span", span)
    order = [F.col("turn").asc_nulls_first(), "tie", "t1", "t2"]
    local = F.row_number().over(Window.partitionBy("conv_id", "span").orderBy(*order))
    sizes = turns.groupBy("conv_id", "span").agg(F.count("*").alias("size"))
    before = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    skips = sizes.select("conv_id", "span", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("skip"))
    return (turns.withColumn("i", local).join(skips, ["conv_id", "span"])
            .withColumn("i", (F.col("i") + F.col("skip")).cast("long")).drop("span", "skip"))


def _turns(table: DataFrame) -> DataFrame:
    """``conv_id, i, t1, t2, bytes`` of every turn; rows without a conv_id belong to no conversation."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = (table.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"), text.alias("text"))
            .where("conv_id is not null"))
    cells = rows.select("conv_id", "turn", F.xxhash64(F.lit(1), "role", F.octet_length("role"), "text").alias("t1"),
                        F.xxhash64(F.lit(2), "text", F.octet_length("text"), "role").alias("t2"), F.octet_length("text").cast("long").alias("bytes"))
    cells = stored(cells, "turns")
    many = (cells.groupBy("conv_id", "turn").agg(F.min("t1").alias("a"), F.max("t1").alias("b")).where("a <> b").select("conv_id", "turn"))
    many = stored(many, "ties")
    if many.isEmpty():
        return _numbered(cells.withColumn("tie", F.lit(0)))
    # only turns that share a place with another text need their texts to be ordered
    named = many.select(F.col("conv_id").alias("c"), F.col("turn").alias("p"))
    tied = rows.join(named, (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("p"))).select("conv_id", "turn", "role", "text").distinct()
    tied = tied.select("conv_id", "turn", F.xxhash64(F.lit(1), "role", F.octet_length("role"), "text").alias("t1"),
                       F.xxhash64(F.lit(2), "text", F.octet_length("text"), "role").alias("t2"),
                       F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")).alias("tie"))
    tied = tied.select(F.col("conv_id").alias("c"), F.col("turn").alias("p"), F.col("t1").alias("u1"), F.col("t2").alias("u2"), "tie")
    same = (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("p")) & (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2"))
    return _numbered(cells.join(tied, same, "left").withColumn("tie", F.coalesce("tie", F.lit(0))).drop("c", "p", "u1", "u2"))


def _rebuilt(turns: DataFrame, group: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(``c, len`` of every rebuilt conversation, ``c, d, len, t1, t2, bytes`` of its turns).

    Conversation c takes the first h turns of c - c % group, then its own after its first h; h = crc32(c) % most.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    base, h = F.col("conv_id") - F.col("conv_id") % group, F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    plan = sizes.select(F.col("conv_id").alias("c"), "own", base.alias("base"), h.alias("h"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    plan = (plan.join(bases, "base", "left").withColumn("led", F.least(F.col("h"), F.coalesce("of_base", F.lit(0))))
            .select("c", "base", "h", "led", (F.col("led") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len")))
    plan = stored(plan, "plan")
    own = (turns.join(plan.withColumnRenamed("c", "conv_id"), "conv_id").where("i > h")
           .select(F.col("conv_id").alias("c"), (F.col("led") + F.col("i") - F.col("h")).alias("d"), "len", "t1", "t2", "bytes"))
    heads = turns.where(f"i < {most} and conv_id % {group} = 0").withColumnRenamed("conv_id", "base")
    led = heads.join(plan, "base").where("i <= led").select("c", F.col("i").alias("d"), "len", "t1", "t2", "bytes")
    return plan.select("c", "len"), own.unionByName(led)


def _running(rows: DataFrame, keys: list[str], values: list[str], backwards: bool = False) -> DataFrame:
    """Running sums of ``values`` along ``d`` within ``keys``, in spans of ``RUN`` places, so no key fills a task."""
    rows = rows.withColumn("span", F.floor((F.col("d") - 1) / RUN))
    place, span = (F.col("d").desc(), F.col("span").desc()) if backwards else (F.col("d"), F.col("span"))
    inside = Window.partitionBy(*keys, "span").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({v: F.sum(v).over(inside) for v in values})
    totals = rows.groupBy(*keys, "span").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    earlier = Window.partitionBy(*keys).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "span", *[F.coalesce(F.sum(f"_{v}").over(earlier), F.lit(0)).alias(f"_{v}") for v in values])
    both = local.join(totals, [*keys, "span"])
    return both.withColumns({v: F.col(v) + F.col(f"_{v}") for v in values}).drop("span", *[f"_{v}" for v in values])


def _prefixes(turns: DataFrame) -> DataFrame:
    """``c, d, len, bytes, g1, g2`` and the digest of the prefix before, ``p1, p2``, of every prefix of a turn or more."""
    def lanes(salt: int):
        h = F.xxhash64(F.lit(salt), "t1", "t2", "d")
        return h.bitwiseAND(F.lit(_WORD)), F.shiftrightunsigned(h, 32)
    (a, b), (c, e) = lanes(3), lanes(4)
    own = [a.alias("o1"), b.alias("o2"), c.alias("o3"), e.alias("o4")]
    rows = turns.select("c", "d", "len", "bytes", *own).withColumns({s: F.col(s.replace("s", "o")) for s in _LANES})
    summed = _running(rows, ["c"], _LANES)
    before = [F.col(s) - F.col(s.replace("s", "o")) for s in _LANES]

    def digest(sums, d):
        return F.xxhash64(F.lit(5), *sums, d), F.xxhash64(F.lit(6), *reversed(sums), d)
    g, p = digest([F.col(s) for s in _LANES], F.col("d")), digest(before, F.col("d") - 1)
    return summed.select("c", "d", "len", "bytes", g[0].alias("g1"), g[1].alias("g2"), p[0].alias("p1"), p[1].alias("p2"))


def _cells(g1: np.ndarray, g2: np.ndarray, cells: int) -> list[np.ndarray]:
    return [(mix(g1.view(np.uint64) + g2.view(np.uint64) * np.uint64(2 * k + 1)) & np.uint64(cells - 1)).astype(np.int64) for k in range(ROWS)]


def sketch(prefixes: DataFrame, cells: int = CELLS) -> np.ndarray:
    """Count-min sketch of (g1, g2), counts cut at 2: ``ROWS`` rows of ``cells`` bytes.

    Tasks send the filled cells of each slice with their counts; a task adds up a slice. The driver gets
    the sketch, whose size does not depend on the input.
    """
    slices = 16
    width = cells // slices

    def fill(batches):
        release()
        seen = np.zeros((ROWS, cells), np.uint8)
        for batch in batches:
            g = [batch.column(c).to_numpy() for c in ("g1", "g2")]
            for row, at in zip(seen, _cells(*g, cells)):
                once, n = np.unique(at, return_counts=True)
                row[once] = np.minimum(row[once] + np.minimum(n, 2), 2)
        for k, row in enumerate(seen):
            if row.any():
                pieces = row.reshape(slices, width)
                yield pa.RecordBatch.from_arrays([pa.array([k * slices + i for i in range(slices)], pa.int32()),
                                                  pa.array([zlib.compress(x.tobytes(), 1) for x in pieces])], ["slice", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                total[i] = np.minimum(total.get(i, 0) + np.frombuffer(zlib.decompress(raw), np.uint8), 2).astype(np.uint8)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()])], ["slice", "counts"])
    schema = "slice int, counts binary"
    out = np.zeros((ROWS, cells), np.uint8)
    # partial sums by task first, so that few rows of a slice meet
    sent = prefixes.select("g1", "g2").mapInArrow(fill, schema)
    for r in sent.repartition(slices * ROWS, "slice").mapInArrow(add, schema).collect():
        k, i = divmod(r["slice"], slices)
        out[k, i * width:(i + 1) * width] = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
    return out


def _screened(prefixes: DataFrame, cells: int) -> DataFrame:
    """Add ``one`` and ``before_one``: the sketch proves that only c starts with the prefix, and with the one before it."""
    spark = prefixes.sparkSession
    shared = spark.sparkContext.broadcast(sketch(prefixes, cells))

    def judge(batches):
        counts = shared.value
        for batch in batches:
            marks = []
            for names in (("g1", "g2"), ("p1", "p2")):
                at = _cells(*[batch.column(c).to_numpy() for c in names], cells)
                marks.append(np.min([row[i] for row, i in zip(counts, at)], axis=0) <= 1 if batch.num_rows else np.zeros(0, bool))
            # the root is a prefix of all and has no cell of its own
            root = batch.column("d").to_numpy() == 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks[0]), pa.array(marks[1] & ~root)], [*batch.schema.names, "one", "before_one"])
    schema = ", ".join(f"{n} {t}" for n, t in prefixes.dtypes)
    return prefixes.mapInArrow(judge, f"{schema}, one boolean, before_one boolean")


def _ends(members: DataFrame) -> DataFrame:
    """``g1, g2, ends_sha256`` over (g1, g2, c): SHA-256 of the ids in order, comma-joined.

    Ids are dealt by (node, id), so a node's are joined to pieces of 64 KB in many tasks; one task then
    hashes the pieces of a node as they come, and holds one at a time.
    """
    piece = PIECE

    def join(batches):
        key, texts, first, size = None, [], 0, 0
        for batch in batches:
            for a, b, c in zip(*[batch.column(n).to_pylist() for n in ("g1", "g2", "c")]):
                if key != (a, b) or size > piece:
                    if texts:
                        yield _row(key, first, texts)
                    key, texts, first, size = (a, b), [], c, 0
                texts.append(str(c))
                size += len(texts[-1]) + 1
        if texts:
            yield _row(key, first, texts)

    def _row(key, first, texts):
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([first]), pa.array([",".join(texts)])], ["g1", "g2", "first", "ids"])

    def digest(batches):
        key, state = None, None
        for batch in batches:
            for a, b, ids in zip(*[batch.column(n).to_pylist() for n in ("g1", "g2", "ids")]):
                if key != (a, b):
                    if state is not None:
                        yield _hashed(key, state)
                    key, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state is not None:
            yield _hashed(key, state)

    def _hashed(key, state):
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([state.hexdigest()])], ["g1", "g2", "ends_sha256"])
    dealt = members.repartitionByRange("g1", "g2", "c").sortWithinPartitions("g1", "g2", "c")
    pieces = dealt.mapInArrow(join, "g1 long, g2 long, first long, ids string")
    return (pieces.repartition("g1", "g2").sortWithinPartitions("g1", "g2", "first")
            .mapInArrow(digest, "g1 long, g2 long, ends_sha256 string"))


def prefix_trie(table: DataFrame, group: int = 5, most: int = 9, cells: int = CELLS) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations of ``table`` (``conv_id, turn, role, text``).

    Conversation c is the first h turns of conversation c - c % ``group`` (the remainder takes the sign of c), then its own
    after its first h, with h = crc32(decimal c) % ``most``. Turns are ordered by turn (null first), then role and
    text; null role or text is empty, repeated rows are turns of their own, rows without a conv_id are left out, other columns are not
    looked at. An empty table has no conversation to rebuild, so it gives no rows.

    One row a node, the textless root included: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``; see the query's contract for their meaning.
    """
    spark = table.sparkSession
    narrow_batches(spark, 10_000)
    plan, turns = _rebuilt(stored(_turns(table), "numbered"), group, most)
    rows = stored(_screened(stored(_prefixes(turns), "prefixes"), cells), "screened")
    # the sketch may fail to prove a prefix of one that it proved before: such rows learn their first proof
    proofs = rows.where("one").groupBy("c").agg(F.min("d").alias("proof"))
    sure = rows.where("one and before_one")
    unsure = (rows.where("not (one and before_one)").join(proofs, "c", "left")
              .withColumns({"one": F.coalesce(F.col("d") >= F.col("proof"), F.lit(False)), "before_one": F.coalesce(F.col("d") > F.col("proof"), F.lit(False))})
              .withColumns({p: F.when(F.col("d") == 1, F.lit(0)).otherwise(F.col(p)) for p in ("p1", "p2")}).drop("proof"))
    unsure = stored(unsure, "unsure")
    # proven singletons: all but the parent of the first one is known from the row
    sha, nil = F.sha2(F.col("c").cast("string").cast("binary"), 256), F.lit(0).cast("long")
    alone = [F.col("c").alias("conv_id"), F.col("d").alias("depth"), "p1", "p2", F.lit(1).cast("long").alias("n_convs"),
             (F.col("d") < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), nil.alias("saved_tokens"),
             F.when(F.col("d") == F.col("len"), sha).otherwise(F.lit(_EMPTY)).alias("ends_sha256")]
    tops = unsure.where("one and not before_one").select(*alone)
    inner = sure.unionByName(unsure.where("one and before_one")).select(*alone).withColumn("parent_conv_id", F.col("conv_id"))

    # the others are grouped exactly; the root, which all start with, is one more of them, with digest (0, 0)
    none = F.lit(None).cast("long")
    roots = plan.select("c", nil.alias("d"), "len", nil.alias("bytes"), nil.alias("g1"), nil.alias("g2"), none.alias("p1"), none.alias("p2"))
    shared = unsure.where("not one").select(*roots.columns).unionByName(roots)
    node = (shared.groupBy("g1", "g2").agg(F.min("c").alias("rep"), F.first("d").alias("depth"), F.count("*").alias("n"), F.max("len").alias("longest"),
                                           F.first("bytes").alias("bytes"), F.first("p1").alias("p1"), F.first("p2").alias("p2")))
    node = stored(node, "nodes")
    # what a node adds to all its ancestors goes to its smallest member, whose row has them all
    own = node.select(F.col("rep").alias("c"), F.col("depth").alias("d"), ((F.col("n") - 1) * F.col("bytes")).alias("saved"),
                      (F.col("longest") == F.col("depth")).cast("long").alias("leaves"))
    leaf = tops.select(F.col("conv_id").alias("c"), (F.col("depth") - 1).alias("d"), nil.alias("saved"), F.lit(1).cast("long").alias("leaves"))
    own = own.unionByName(leaf).groupBy("c", "d").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    weighted = (shared.select("c", "d", "g1", "g2").join(own, ["c", "d"], "left").withColumn("d", F.col("d") + 1)
                .withColumns({"saved": F.coalesce("saved", F.lit(0)), "leaves": F.coalesce("leaves", F.lit(0))}))
    below = (_running(weighted, ["c"], ["saved", "leaves"], backwards=True).groupBy("g1", "g2")
             .agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves")))
    children = (node.where("depth > 0").select("p1", "p2").unionByName(tops.select("p1", "p2"))
                .groupBy(F.col("p1").alias("g1"), F.col("p2").alias("g2")).agg(F.count("*").alias("n_children")))
    ends = _ends(shared.where("d = len").select("g1", "g2", "c"))
    full = node.join(below, ["g1", "g2"]).join(children, ["g1", "g2"], "left").join(ends, ["g1", "g2"], "left")
    full = stored(full.select("g1", "g2", "p1", "p2", F.col("rep").alias("conv_id"), "depth", F.col("n").alias("n_convs"), F.coalesce("n_children", nil).alias("n_children"),
                              "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256")), "shared_nodes")

    # parents by digest; those with a thousandth of all children are at most a thousand, and go out as a map
    open_ = full.where("depth > 0").unionByName(tops.withColumns({"g1": nil, "g2": nil}))
    total = full.agg(F.sum("n_children")).first()[0] or 0
    parents = full.where("n_children > 0").select(F.col("g1").alias("p1"), F.col("g2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    many = parents.where(F.col("n_children") * 1000 >= total).drop("n_children")
    few = parents.where(F.col("n_children") * 1000 < total).drop("n_children")
    known = stored(open_.join(F.broadcast(many), ["p1", "p2"], "left"), "open")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rest = known.where("parent_conv_id is null").drop("parent_conv_id").join(few, ["p1", "p2"])
    root = full.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    found = [x.select(*out) for x in (root, known.where("parent_conv_id is not null"), rest, inner)]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
