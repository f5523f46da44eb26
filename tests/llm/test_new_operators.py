"""Collocations, the conversation trie and toxicity scores against brute force and on awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.parity import compare, connect
from textlake.llm import collocations, conversation_trie, queries, toxicity

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("key", ["op11_collocations", "op12_prefix_trie"])
def test_sql(spark, key):
    con = connect(SF)
    assert compare(spark, con, key, queries.QUERIES, queries.ORACLES, SF) in ("", "no rows")


def brute_collocations(rows, least, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in often.items():
            if any(len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            found.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("bits", [27, 4])
def test_collocations(spark, bits):
    """Screens of 16 bits hold back next to nothing; the result is the same."""
    draw = random.Random(3)
    rows = [(" ".join(draw.choice("a B c größe d, e; f\n").strip() or "of The" for _ in range(draw.randrange(60))), draw.choice(["en", "de", None])) for _ in range(200)]
    rows += [(None, "en"), ("", None), ("one", "fr"), (",;.", "fr"), ("hot line with The same words. " * 400, "en"), ("x" * 5000 + " y", "en")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, w1 string, f long").repartition(4)
    for top in (7, None):
        got = sorted(tuple(r) for r in collocations.collocations(df, least=12, top=top, bits=bits).collect())
        assert got == brute_collocations(rows, 12, top)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: (x[0], x[1] or 0, x[2].encode(), x[3].encode()))] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - (abs(c) % 5 * (1 if c >= 0 else -1)), [])[:h] + own[c][h:]
    nodes = collections.defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes[tuple(built[c][:d])].append(c)
    kids = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1].encode()) if k else 0
    return sorted((m[0], len(k), nodes[k[:-1]][0] if k else -1, len(m), kids[k], leaves[k], saved[k],
                   hashlib.sha256(",".join(str(c) for c in m if len(built[c]) == len(k)).encode()).hexdigest()) for k, m in nodes.items())


@pytest.mark.parametrize("cells", [1 << 16, 16])
def test_trie(spark, cells, monkeypatch):
    monkeypatch.setattr(conversation_trie, "RUN", 4)
    monkeypatch.setattr(conversation_trie, "PIECE", 10)
    draw = random.Random(cells)
    rows = []
    for c in [*range(-7, 60), 10 ** 12]:
        rows += [(c, t, draw.choice(["user", None]), draw.choice(["yes", "no", "größe", None])) for t in range(draw.randrange(7))]
    rows += [(61, t, "user", f"{t % 3}") for t in range(40)] + [(66, t, "user", f"{t % 3}") for t in range(40)]
    rows += [(70, None, "b", "x"), (70, None, "a", "y"), (70, None, "a", "y"), (70, 1, "ab", "c"), (70, 1, "a", "bc"), (None, 1, "a", "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, d long").repartition(5)
    got = conversation_trie.prefix_trie(df, cells=cells).collect()
    assert sorted((*(r["parent_conv_id"] if k == "parent_conv_id" and r["depth"] else -1 if k == "parent_conv_id" else r[k] for k in r.asDict()),) for r in got) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert conversation_trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def numbers(net, seq, sizes, x, y):
    pre = np.matmul(x[None], net.p["w"]) + net.p["b"]
    logit, state = net.forward(pre, seq, sizes, keep=True)
    return float((np.logaddexp(0, logit) - y * logit).sum()), logit, state


def test_gradients():
    """The gradients of the network are those of differences."""
    draw = np.random.default_rng(1)
    net = toxicity.Network(np.zeros(0, np.uint64))
    net.p = {k: draw.normal(0, 0.5, v.shape) for k, v in net.p.items()}
    sizes, x, y = np.array([5, 3, 3, 1]), draw.normal(size=(6, 2 * toxicity.DIM)), np.array([1.0, 0, 1, 0])
    seq = toxicity._sequences(np.array([0, 2, 5, 7]), sizes, draw.integers(0, 6, 12))
    _, logit, state = numbers(net, seq, sizes, x, y)
    found, d_pre = net.gradients(1 / (1 + np.exp(-logit)) - y, seq, sizes, state, 6)
    found["w"], found["b"] = np.matmul(x.T[None], d_pre), d_pre.sum(1, keepdims=True)
    for name, grad in found.items():
        at = tuple(draw.integers(0, s) for s in net.p[name].shape)
        kept, ends = net.p[name][at], []
        for step in (1e-3, -1e-3):
            net.p[name][at] = kept + step
            ends.append(numbers(net, seq, sizes, x, y)[0])
        net.p[name][at] = kept
        # hidden states are kept in single precision
        assert abs((ends[0] - ends[1]) / 2e-3 - grad[at]) < 2e-3 * max(1, abs(grad[at])), name


def test_windows_cover():
    at = np.array([0, 0, 1, 97, 400, 400 + 96])
    text, start, sizes = toxicity._windows(at)
    assert set(text) == {1, 2, 3, 4} and sizes.max() <= toxicity.WINDOW
    assert {i for s, n in zip(start, sizes) for i in range(s, s + n)} == set(range(400 + 96))


def test_toxicity(spark):
    """Held-out accuracy on texts whose bad words share a stem, and defined scores for awkward rows."""
    draw = random.Random(5)
    syllables = ["ba", "ne", "ti", "ro", "su", "la", "me", "ko"]

    def word():
        return "".join(draw.choice(syllables) for _ in range(draw.randrange(1, 5)))
    rows = []
    for i in range(600):
        text = [word() for _ in range(draw.randrange(5, 200))]
        for _ in range(1 + len(text) // 30 if i % 3 == 0 else 0):
            text[draw.randrange(len(text))] = "zlurx" + word()
        rows.append((i, " ".join(text), int(i % 3 == 0)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, None, "x"), (900, "", "x"), (901, "?!", "x"), (902, "y" * 100_000, "x"), (3, rows[3][1], "x")],
                                 "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.col("doc_id") % 5 != 0)
    got = {(r["doc_id"], r["score"], r["predicted"]) for r in toxicity.score(docs, model).collect()}
    assert all(0 <= s <= 1 and p == (s >= 0.5) for _, s, p in got)
    by_id = {d: p for d, _, p in got}
    assert by_id[None] == by_id[900] == by_id[901] == 0 and 902 in by_id
    held = [(by_id[i], y) for i, _, y in rows if i % 5 == 0]
    assert np.mean([p == y for p, y in held]) > 0.9
    assert toxicity.train(docs, labels, F.col("doc_id") % 5 != 0)[0] == model[0]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [tuple(r) for r in toxicity.score(docs, toxicity.train(docs, none)).collect()] == [(1, 0.0, 0)]
    assert toxicity.score(docs.limit(0), (None, 0.2)).count() == 0


def test_pipeline_stages_with_clashing_names(spark):
    """Columns named like a stage's own stay as they are; rows that share an id or have none keep their texts."""
    import corpus_pipeline
    text = [" ".join(f"word{chr(97 + (i * k) % 23)} und{k % 7}" for k in range(40)) for i in range(1, 7)]
    rows = [(1, text[0], "en", "a", 1), (1, text[1], "en", "a", 2), (None, text[2], "en", "a", 3), (None, text[2], "en", "b", 4), (2, text[0], "en", "b", 5)]
    names = ["_s", "_L", "_t", "_kept", "_score", "_accepted", "_lang_pred", "own", "_own"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names)
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], schema)
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, SF).columns == docs.columns
    left = corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left) == sorted([(1, text[0]), (1, text[1]), (0, text[2])])
    assert all([r[n] for n in names] == list(range(len(names))) for r in left)
