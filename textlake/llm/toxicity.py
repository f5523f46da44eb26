"""Toxicity of whole texts by a bidirectional gated recurrent network with attention pooling.

A word enters as the embedding of the word itself, where training saw it often enough, beside the mean
embedding of its character n-grams, so spellings never seen are still read. The network runs over windows
that overlap; a text's score is that of its most toxic window, calibrated on texts left out of the fit. Training
is numpy in one task, over a bounded sample of labelled rows; scoring is one narrow pass.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm.blocks import chunks, mix, narrow_batches, release, text_bytes
from textlake.llm.words import LOWER, span_hash, word_spans

#: Labelled documents of each class that the network learns from, drawn by a hash of doc_id, and windows of each.
TRAIN_DOCS, TRAIN_WINDOWS = 1500, 4
#: One in so many drawn documents is left out of the fit and calibrates the score.
HELD = 8
#: Words of a window, and from the start of one window to that of the next.
WINDOW, STRIDE = 96, 72
#: Bytes of a token; longer words are read as several.
TOKEN_BYTES = 24
HIDDEN, DIM = 16, 12
BUCKET_BITS = 14
GRAMS = (3, 4, 5)
#: A word has an embedding of its own when so many training windows hold it.
WORD_WINDOWS = 5
EPOCHS, BATCH, RATE = 4, 128, 0.01
#: Few windows make smaller batches and more rounds, so that training has so many steps at least.
STEPS = 200
TEXT_BYTES = 1 << 19


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end of every token, n + 1 offsets of the tokens of each text)."""
    value, starts, ends = word_spans(data, offsets, "punctuation")
    pieces = -(-(ends - starts) // TOKEN_BYTES)
    if len(pieces) and pieces.max() > 1:
        first = np.repeat(starts, pieces)
        nth = np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = first + nth * TOKEN_BYTES
        ends = np.minimum(starts + TOKEN_BYTES, np.repeat(ends, pieces))
        value = span_hash(LOWER[data], starts, ends)
    return value, starts, ends, np.searchsorted(starts, offsets)


def _grams(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram at each byte of the marked words, a column per n, 0 where none fits; first byte of each word)."""
    sizes = ends - starts + 2
    first = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(len(word)) - first[word]
    marked = np.full(len(word), 256, np.uint64)
    inner = (place > 0) & (place < sizes[word] - 1)
    marked[inner] = code[(starts[word] + place - 1)[inner]]
    out = np.zeros((len(word), len(GRAMS)), np.int64)
    value = mix(marked + np.uint64(1))
    unit = value.copy()
    for n in range(2, max(GRAMS) + 1):
        value[:len(word) - n + 1] = value[:len(word) - n + 1] * np.uint64(0x9DDFEA08EB382D69) + unit[n - 1:]
        if n in GRAMS:
            fits = place + n <= sizes[word]
            bucket = (mix(value) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
            out[fits, GRAMS.index(n)] = np.maximum(bucket[fits], 1)
    return out, first


def _windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first token, tokens) of all windows; together they cover every token of every text."""
    sizes = np.diff(at)
    n = np.where(sizes > 0, 1 + np.maximum(-(-(sizes - WINDOW) // STRIDE), 0), 0)
    text = np.repeat(np.arange(len(sizes)), n)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    start = at[:-1][text] + nth * STRIDE
    return text, start, np.minimum(WINDOW, at[1:][text] - start)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters by name, float32; ``word`` row 0 is for words without an embedding, ``gram`` row 0 stays zero."""

    SHAPES = {"w": (2, 2 * DIM, 3 * HIDDEN), "b": (2, 1, 3 * HIDDEN), "u": (2, HIDDEN, 3 * HIDDEN), "c": (2, 1, HIDDEN),
              "att": (2 * HIDDEN, HIDDEN), "att_b": (HIDDEN,), "pick": (HIDDEN,), "out": (2 * HIDDEN,), "out_b": (1,)}

    def __init__(self, words: np.ndarray, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.words, self.scale = words, np.array([1.0, 0.0])
        self.p = {k: (draw.normal(0, 1 / np.sqrt(s[-2] if len(s) > 1 else s[0]), s) if not k.endswith("b") and k != "c" else np.zeros(s)).astype(np.float32)
                  for k, s in self.SHAPES.items()}
        self.p["word"] = draw.normal(0, 0.1, (len(words) + 1, DIM)).astype(np.float32)
        self.p["gram"] = draw.normal(0, 0.05, (1 << BUCKET_BITS, DIM)).astype(np.float32)
        self.p["gram"][0] = 0

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, words=self.words, scale=self.scale, **self.p)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Network:
        found = dict(np.load(io.BytesIO(raw)))
        self = cls.__new__(cls)
        self.words, self.scale = found.pop("words"), found.pop("scale")
        self.p = found
        return self

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Row of ``word`` of each hash."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at + 1, 0)

    def inputs(self, rows: np.ndarray, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Input vector of each distinct word."""
        total = np.add.reduceat(self.p["gram"][grams].sum(1), first, 0)
        return np.concatenate([self.p["word"][rows], total / np.add.reduceat((grams > 0).sum(1), first)[:, None].astype(np.float32)], 1)

    def forward(self, pre: np.ndarray, seq: np.ndarray, sizes: np.ndarray, keep: bool = False):
        """Logit of each window. ``pre``: gate inputs of the words, (2, words, 3 H); ``seq``: (2, steps, windows) word numbers
        forwards and backwards; ``sizes``: tokens of the windows, descending."""
        p, (steps, n) = self.p, seq.shape[1:]
        live = np.searchsorted(-sizes, -np.arange(steps), side="left")
        hidden = np.zeros((steps + 1, 2, n, HIDDEN), np.float32)
        saved = []
        for t in range(steps):
            m = live[t]
            h = hidden[t, :, :m]
            x = np.stack([pre[0, seq[0, t, :m]], pre[1, seq[1, t, :m]]])
            v = np.matmul(h, p["u"])
            gates = _sigmoid(x[..., :2 * HIDDEN] + v[..., :2 * HIDDEN])
            r, z = gates[..., :HIDDEN], gates[..., HIDDEN:]
            inner = v[..., 2 * HIDDEN:] + p["c"]
            new = np.tanh(x[..., 2 * HIDDEN:] + r * inner)
            hidden[t + 1, :, :m] = new + z * (h - new)
            if keep:
                saved.append((r, z, inner, new))
        back = np.maximum(sizes[None, :] - 1 - np.arange(steps)[:, None], 0)
        both = np.concatenate([hidden[1:, 0], hidden[1 + back, 1, np.arange(n)[None, :]]], 2)
        tanh = np.tanh(both @ p["att"] + p["att_b"])
        weight = np.where(np.arange(steps)[:, None] < sizes[None, :], tanh @ p["pick"], -1e9)
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnh->nh", weight, both)
        logit = pooled @ p["out"] + p["out_b"][0]
        return (logit, (hidden, live, saved, back, both, tanh, weight, pooled)) if keep else logit

    def gradients(self, grad: np.ndarray, seq: np.ndarray, sizes: np.ndarray, state, n_words: int) -> tuple[dict, np.ndarray]:
        """(gradients of the dense parameters, gradient of ``pre``) for the gradient of the logits."""
        p, (steps, n) = self.p, seq.shape[1:]
        hidden, live, saved, back, both, tanh, weight, pooled = state
        g = {k: np.zeros_like(p[k]) for k in self.SHAPES}
        g["out"], g["out_b"] = grad @ pooled, np.array([grad.sum()])
        d_pooled = grad[:, None] * p["out"]
        d_both = weight[..., None] * d_pooled
        d_weight = np.einsum("tnh,nh->tn", both, d_pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        d_tanh = d_score[..., None] * p["pick"] * (1 - tanh ** 2)
        g["pick"] = np.einsum("tn,tnh->h", d_score, tanh)
        g["att"], g["att_b"] = np.einsum("tni,tnj->ij", both, d_tanh), d_tanh.sum((0, 1))
        d_both = d_both + d_tanh @ p["att"].T
        d_hidden = np.zeros((steps, 2, n, HIDDEN), np.float32)
        d_hidden[:, 0] = d_both[..., :HIDDEN]
        valid = np.arange(steps)[:, None] < sizes[None, :]
        where = np.nonzero(valid)
        d_hidden[back[where], 1, where[1]] = d_both[..., HIDDEN:][where]
        d_pre = np.zeros((2, n_words, 3 * HIDDEN), np.float32)
        d_h = np.zeros((2, n, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            m = live[t]
            r, z, inner, new = saved[t]
            before = hidden[t, :, :m]
            d = d_h[:, :m] + d_hidden[t, :, :m]
            d_new = d * (1 - z) * (1 - new ** 2)
            d_z = d * (before - new) * z * (1 - z)
            d_r = d_new * inner * r * (1 - r)
            d_v = np.concatenate([d_r, d_z, d_new * r], 2)
            g["u"] += np.matmul(before.transpose(0, 2, 1), d_v)
            g["c"] += (d_new * r).sum(1, keepdims=True)
            d_x = np.concatenate([d_r, d_z, d_new], 2)
            for k in (0, 1):
                np.add.at(d_pre[k], seq[k, t, :m], d_x[k])
            d_h[:, :m] = d * z + np.matmul(d_v, p["u"].transpose(0, 2, 1))
        return g, d_pre


def _sequences(start: np.ndarray, sizes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """(2, steps, windows) word numbers of each window, forwards and backwards."""
    steps = np.arange(int(sizes.max()))[:, None]
    inside = steps < sizes[None, :]
    there = np.where(inside, start[None, :] + steps, start[None, :])
    back = np.where(inside, start[None, :] + sizes[None, :] - 1 - steps, start[None, :])
    return np.stack([word[there], word[back]])


def _logits(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Largest window logit of each text, minus infinity for texts without a token."""
    best = np.full(len(offsets) - 1, -np.inf)
    value, starts, ends, at = _tokens(data, offsets)
    if not len(value):
        return best
    text, start, sizes = _windows(at)
    distinct, first, word = np.unique(value, return_index=True, return_inverse=True)
    grams, begin = _grams(LOWER[data], starts[first], ends[first])
    x = net.inputs(net.rows(distinct), grams, begin)
    pre = np.matmul(x[None], net.p["w"]) + net.p["b"]
    order = np.argsort(-sizes, kind="stable")
    for lo in range(0, len(order), 1024):
        pick = order[lo:lo + 1024]
        logit = net.forward(pre, _sequences(start[pick], sizes[pick], word), sizes[pick])
        np.maximum.at(best, text[pick], logit)
    return best


def _fit(texts: list[bytes], labels: np.ndarray, ids: np.ndarray) -> Network:
    """Train on windows of the texts; texts whose place is a multiple of ``HELD`` calibrate the score."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    value, starts, ends, at = _tokens(data, offsets)
    text, start, sizes = _windows(at)
    held = np.arange(len(texts)) % HELD == 0 if len(texts) >= 4 * HELD else np.zeros(len(texts), bool)
    # so many windows of a text at most, drawn by hash
    drawn = mix(start.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    order = np.lexsort((drawn, text))
    nth = np.arange(len(order)) - np.searchsorted(text[order], text[order])
    pick = np.sort(order[(nth < TRAIN_WINDOWS) & ~held[text[order]]])
    text, start, sizes = text[pick], start[pick], sizes[pick]
    distinct, first, word = np.unique(value, return_index=True, return_inverse=True)
    inside = [np.unique(word[s:s + n]) for s, n in zip(start.tolist(), sizes.tolist())]
    windows = np.bincount(np.concatenate(inside), minlength=len(distinct)) if inside else np.zeros(len(distinct), np.int64)
    net = Network(distinct[windows >= WORD_WINDOWS])
    rows, (grams, begin) = net.rows(distinct), _grams(LOWER[data], starts[first], ends[first])
    ends_at = np.append(begin[1:], len(grams))
    y = labels[text]
    weight = np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-9), 0.5 / max((y == 0).mean(), 1e-9))
    draw = np.random.default_rng(11)
    adam = {k: (np.zeros_like(net.p[k]), np.zeros_like(net.p[k])) for k in Network.SHAPES}
    seen = {k: np.full_like(net.p[k], 1e-8) for k in ("word", "gram")}
    step = 0
    batch = min(BATCH, max(16, len(text) // 16))
    epochs = max(EPOCHS, -(-STEPS * batch // max(len(text), 1)))
    for epoch in range(epochs):
        rate = RATE * (1 - 0.9 * epoch / epochs)
        shuffled = draw.permutation(len(text))
        for lo in range(0, len(shuffled), batch):
            some = shuffled[lo:lo + batch]
            some = some[np.argsort(-sizes[some], kind="stable")]
            seq = _sequences(start[some], sizes[some], word)
            own, back = np.unique(seq, return_inverse=True)
            seq = back.reshape(seq.shape)
            lengths = ends_at[own] - begin[own]
            first_own = np.cumsum(lengths) - lengths
            g = grams[np.arange(lengths.sum()) + np.repeat(begin[own] - first_own, lengths)]
            # now and then a word is read by its characters alone, as rare words are, or not at all
            known = np.where(draw.random(len(own)) < 0.3, 0, rows[own])
            read = (draw.random(len(own)) > 0.2)[:, None]
            x = net.inputs(known, g, first_own) * read
            pre = np.matmul(x[None], net.p["w"]) + net.p["b"]
            logit, state = net.forward(pre, seq, sizes[some], keep=True)
            slope = ((_sigmoid(logit) - y[some]) * weight[some] / len(some)).astype(np.float32)
            grads, d_pre = net.gradients(slope, seq, sizes[some], state, len(own))
            grads["w"], grads["b"] = np.matmul(x.T[None], d_pre), d_pre.sum(1, keepdims=True)
            d_x = np.einsum("kuj,kij->ui", d_pre, net.p["w"]) * read
            step += 1
            for k, d in grads.items():
                m, v = adam[k]
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                net.p[k] -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
            share = (d_x[:, DIM:] / np.add.reduceat((g > 0).sum(1), first_own)[:, None])[np.repeat(np.arange(len(own)), lengths)]
            for k, at_row, d in (("word", known, d_x[:, :DIM]), ("gram", g.ravel(), np.repeat(share, len(GRAMS), 0))):
                order = np.argsort(at_row, kind="stable")
                hit, begin_hit = np.unique(at_row[order], return_index=True)
                total = np.add.reduceat(d[order], begin_hit, 0)
                seen[k][hit] += total ** 2
                net.p[k][hit] -= 5 * rate * total / np.sqrt(seen[k][hit])
            net.p["gram"][0] = 0
    _calibrate(net, _logits(net, data, offsets), labels, held if held.any() else np.ones(len(texts), bool))
    return net


def _calibrate(net: Network, logits: np.ndarray, labels: np.ndarray, held: np.ndarray) -> None:
    """Slope and shift of the logit by a logistic fit on the held-out texts, both classes weighing the same."""
    use = held & np.isfinite(logits)
    x, y = logits[use], labels[use].astype(float)
    if not len(x) or not 0 < y.mean() < 1:
        return
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    # targets short of 0 and 1, so that a separable sample has a fit
    y = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))

    def loss(v: np.ndarray) -> float:
        t = v[0] * x + v[1]
        return float((weight * (np.logaddexp(0, t) - y * t)).sum() + 5e-4 * (v[0] - 1) ** 2)
    best = np.array([1.0, 0.0])
    for _ in range(50):
        q = _sigmoid(best[0] * x + best[1])
        s, h = weight * (q - y), weight * q * (1 - q)
        slope = np.array([(s * x).sum() + 1e-3 * (best[0] - 1), s.sum()])
        bend = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-9]])
        move, before = np.linalg.solve(bend, slope), loss(best)
        while loss(best - move) > before and np.abs(move).max() > 1e-9:
            move = move / 2
        best = best - move
    a, b = best
    net.scale = np.array([max(a, 0.05), b])


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, per_class: int = TRAIN_DOCS) -> tuple[bytes | None, float]:
    """(network, share of label 1) learned from ``docs`` (``doc_id``, ``text``) by ``labels`` (``doc_id``, ``toxic``) where ``learn`` holds.

    At most ``per_class`` doc_ids of each class are drawn, by a hash of doc_id; their ids are the only rows on the driver.
    A doc_id with several labels has the largest; null labels and ids are left out. No network when a class has no text.
    """
    spark = docs.sparkSession
    narrow_batches(spark, 200)
    known = labels.where("doc_id is not null and toxic is not null")
    known = (known if learn is None else known.where(learn)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    drawn = {}
    for value in (0, 1):
        for r in known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect():
            drawn[r["doc_id"]] = value
    if len(set(drawn.values())) < 2:
        return None, share

    def fit(batches):
        release()
        rows = sorted({(d, t.encode()) for b in batches for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())})
        rows.sort(key=lambda r: (int(mix(np.array([r[0]], np.int64).view(np.uint64))[0]), r[1]))
        y = np.array([drawn[d] for d, _ in rows])
        if len(rows) and 0 < y.mean() < 1 and any(len(_tokens(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]) for _, t in rows):
            net = _fit([t for _, t in rows], y, np.array([d for d, _ in rows]))
            yield pa.RecordBatch.from_arrays([pa.array([net.dump()], pa.binary())], ["net"])
        release()
    chosen = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
              .where(F.col("doc_id").isin(list(drawn)) & (F.length("text") > 0)))
    found = chosen.repartition(1).mapInArrow(fit, "net binary").collect()
    return (bytes(found[0]["net"]) if found else None), share


def score(docs: DataFrame, model: tuple[bytes | None, float]) -> DataFrame:
    """``doc_id, score, predicted`` of every whole text: the calibrated score of its most toxic window.

    A text that is null or has no word gets the share of label 1 among the labels, cut at 0.499 so that it is not
    called toxic, and so do all texts when nothing could be learned. Null ids stay null, repeated rows are scored each.
    """
    spark = docs.sparkSession
    narrow_batches(spark)
    raw, share = model
    shared = spark.sparkContext.broadcast(raw)

    def run(batches):
        release()
        net = Network.load(shared.value) if shared.value else None
        for batch in chunks(batches, limit=TEXT_BYTES):
            prior = min(share, 0.499)
            value = np.full(batch.num_rows, prior)
            if net:
                logit = _logits(net, *text_bytes(batch.column("text")))
                known = np.isfinite(logit)
                value[known] = _sigmoid(net.scale[0] * logit[known] + net.scale[1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, score double, predicted int")
