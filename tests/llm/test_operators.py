"""The training-data operators against brute force, on the smallest tables and on awkward rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.parity import compare, connect
from textlake.llm import language, license, mixing, nearest, ngram_join, ngram_lm, packing, queries, sharding, suffix_dedup, vectors, word_lm
from textlake.llm.block_topk import quantised, top_products
from textlake.llm.blocks import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"word{i % 997} and{i}" for i in range(6000))
ROWS = [(1, None, "en", "a", 0, "x"), (2, "", None, None, None, None), (3, "One two three", "en", "a", 13, "x"), (4, "one  two\nTHREE", "en", "b", 14, "x"),
        (5, LONG, "en", "a", len(LONG), "x"), (6, LONG + " tail", "en", "a", 0, "x"), (7, LONG, "de", "a", 0, "x"), (7, LONG, "de", "a", 0, "x"),
        (8, "größe " * 30, "de", "b", 0, "x"), (9, "größe " * 31, "de", "b", 0, "x"), (10, "12345 !!! ---", "en", "b", 0, "x"),
        (11, "<|endoftext|> don't we'll é́ 日本語", "en", "b", 0, "x"), (12, "aaaa" * 40, "en", "c", 0, "x"), (13, "aaaa" * 60, "en", "c", 0, "x")]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def table(spark):
    return [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.mark.parametrize("key", ["op1_ngram_jaccard_join", "op8_block_top_k", "op10_suffix_dedup"])
def test_sql(spark, key):
    assert compare(spark, connect(SF), key, queries.QUERIES, queries.ORACLES, SF) == ""


def brute_components(rows, size, percent):
    sets = {}
    for doc, text in rows:
        w = words(text)
        sets[doc] = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return {d: (len(sets[d]), root[d]) for d in sets}


def test_jaccard_awkward_rows(docs, none):
    want = brute_components([(r[0], r[1]) for r in ROWS], 4, 85)
    got = ngram_join.jaccard_components(docs).collect()
    assert len(got) == len(ROWS)
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got)
    assert ngram_join.jaccard_components(none).count() == 0


def test_jaccard_star_with_unlinked_members(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:60 - i % 7] + [f"x{i}y{k}" for k in range(i % 7)])) for i in range(1, 60)]
    want = brute_components(rows, 4, 85)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_derived_overlaps():
    rng = np.random.default_rng(0)
    pivot = np.unique(rng.integers(0, 300, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(pivot, 120), rng.integers(0, 400, 30).astype(np.uint64)])) for _ in range(30)]
    n = np.array([len(s) for s in sets])
    x, y = ngram_join.derived_links(pivot, sets, sets, n, n, 60)
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 100 * len(np.intersect1d(a, b)) >= 60 * len(np.union1d(a, b))}
    assert set(zip(x.tolist(), y.tolist())) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 150)]
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 150: 150, 200: 150}


def brute_removed(rows, size=50):
    first, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - size + 1):
            if first.setdefault(raw[i:i + size], doc) < doc:
                gone[i:i + size] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0
        out[doc] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_awkward_rows(docs, none):
    want = brute_removed([(r[0], r[1]) for r in ROWS])
    got = suffix_dedup.removed_spans(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert tuple(r)[1:] == want[r["doc_id"]], r["doc_id"]
    kept = suffix_dedup.removed_spans(docs, keep=True)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert suffix_dedup.removed_spans(none).count() == 0


def test_suffix_dedup_frequent_anchor(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    line = "this line of some fifty-five bytes stands in many of them"
    rows = [(i, f"head {i * 7919} {i} {line} tail {i * 104729}") for i in range(40)]
    want = brute_removed(rows)
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.removed_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_packing(docs, none):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.best_fit(packing.pieces(docs, queries.tokenizer_path(), 512), 512).collect()
    texts = {r[0]: r[1] for r in ROWS}
    bins, seen = collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        ids = np.array(tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [1], "<u4")
        assert r["start"] == 512 * r["piece"] and r["length"] == min(512, len(ids) - r["start"])
        assert zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[r["doc_id"]].add(r["piece"])
        assert len(seen[r["doc_id"]]) <= -(-len(ids) // 512)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.best_fit(packing.pieces(none, queries.tokenizer_path())).count() == 0


def test_plan_fills_bins():
    rng = np.random.default_rng(1)
    lengths = collections.Counter(rng.integers(1, 101, 3000).tolist())
    plan = packing.plan(dict(lengths), 100)
    used = collections.Counter()
    for length, _, times, _, _ in plan:
        used[length] += times
    assert used == lengths
    total = sum(k * v for k, v in lengths.items())
    assert max(s + t for _, _, t, s, _ in plan) <= -(-total // 100) * 1.02
    assert sorted(packing.fullest({7: 1, 5: 3, 3: 1}, 7, 18)) == [3, 7] or sum(packing.fullest({7: 1, 5: 3, 3: 1}, 7, 18)) == 17


def test_licenses(docs, none):
    rows = {r["doc_id"]: r for r in license.scan(docs).collect()}
    assert rows[1]["n_words"] == 0 and rows[3]["labels"] == "" and rows[3]["first_word"] is None
    assert license.scan(none).count() == 0


def test_license_templates(spark):
    texts = ["Released under the MIT License. UNDER THE MIT LICENSE!", "licensed under the Apache License, Version 2.0", "Licensed under CC BY-NC 4.0.",
             "licensed under the terms of the GNU General Public License, version 3", "licensed under terms of the GNU General Public License",
             "All rights reserved. Really, truly. No part of this book may be reproduced", "all rights reserved by the many authors of this fine old book no part of this may be reproduced"]
    got = [tuple(r)[2:8] for r in license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0] == (2, 1, 5, "mit", "mit", 1.0)
    assert got[1] == (1, 3, 3, "apache-2", "apache-2", 1.0)
    assert [g[4] for g in got[2:]] == ["cc-by-nc", "gpl-3", "", "reserved", ""]


def test_license_whole_wordings(spark):
    whole = " ".join(license._pieces(license.TEMPLATES[0][1].replace("<<optional>>", "").replace("<<end>>", "").replace("<<any 12>>", "the authors or copyright holders")))
    notice = "redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License"
    texts = [whole, whole[:whole.index(" the software is provided")], notice.format("", "2"), notice.format("Lesser ", "2.1"), notice.format("Affero ", "3")]
    got = license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["labels"] for r in got] == ["mit", "", "gpl-2", "lgpl-2.1", "agpl-3"]


def test_language(spark, table, docs, none):
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_language_id"](spark, SF).collect()}
    held = [(d, lang) for d, _, lang in table if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, _, _ in table)
    assert np.mean([got[d]["lang_pred"] == lang for d, lang in held]) > 0.95
    model = language.train(docs)
    rows = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 10)] == ["und"] * 3 and rows[8]["lang_pred"] == "de"
    assert language.train(none) is None
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}


def test_rare_language_keeps_unseen_texts(spark, table):
    english = [(d, t, "en") for d, t, lang in table if lang == "en" and t][:60]
    french = [(d, t, "fr") for d, t, lang in table if lang == "fr" and t and len(t) > 400]
    seen, new = french[:8], french[8:]
    for some in (seen, seen[:2]):
        model = language.train(spark.createDataFrame(english + some, "doc_id long, text string, lang string"))
        best, _, accepted = model.judge([t for _, t, _ in new])
        own = best == model.langs.index("fr")
        assert own.mean() > 0.8 and accepted[own].mean() > 0.9


def test_kneser_ney_shares_sum_to_one():
    table = language._counts(["abracadabra alakazam", "abra kadabra"])
    codes = np.unique(language.letters(["abracadabra alakazam", "abra kadabra"])[0])
    lower = table[0][1].sum() + table[0][3][0]
    assert abs(lower - 1) < 1e-9 and len(codes) - 1 == len(table[0][0])


def test_katz(spark, table):
    got = {r["doc_id"]: r for r in ngram_lm.score(spark.read.parquet(f"{SF}/documents.parquet"), queries.remainder(10) != 0).collect()}
    tokens = {d: words(t) + [None] for d, t, _ in table}
    train = [d for d in tokens if zlib.crc32(str(d).encode()) % 10]
    count = collections.Counter(w for d in train for w in tokens[d])
    total, kinds = sum(count.values()), len(count)
    own = {w for w, n in count.items() if w is not None and n * ngram_lm.SHARE > total}
    name = lambda w: "end" if w is None else w if w in own else "rare"
    pairs, context, single = collections.Counter(), collections.Counter(), collections.Counter()
    for d in train:
        before = "start"
        for w in tokens[d]:
            pairs[before, name(w)] += 1
            context[before] += 1
            single[name(w)] += 1
            before = name(w)
    few = collections.Counter(pairs.values())
    discount = ngram_lm.good_turing(np.array([few[i] for i in range(ngram_lm.CUT + 2)]))
    kept = lambda n: discount[n] * n if n <= ngram_lm.CUT else n
    classes = {*own, "end", "rare"}
    share = {c: (single[c] + 0.5) / sum(single[k] + 0.5 for k in classes) for c in classes}
    follow = collections.defaultdict(dict)
    for (a, b), n in pairs.items():
        follow[a][b] = n
    room = {a: context[a] + (context[a] - sum(map(kept, f.values())) < 0.25) for a, f in follow.items()}
    back = {a: (1 - sum(map(kept, f.values())) / room[a]) / (1 - sum(share[b] for b in f)) for a, f in follow.items()}
    for a, f in follow.items():
        assert abs(sum(kept(f[c]) / room[a] if c in f else back[a] * share[c] for c in classes) - 1) < 1e-9
    rare = [n for w, n in count.items() if w is not None and w not in own]
    once = sum(n == 1 for n in rare)
    for d, ws in tokens.items():
        want, before = 0.0, "start"
        for w in ws:
            c = name(w)
            p = kept(follow[before][c]) / room[before] if c in follow.get(before, {}) else back.get(before, 1.0) * share[c]
            want += np.log10(p * ((count[w] or once) / (sum(rare) + once) if c == "rare" else 1))
            before = c
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in count for w in ws), total)
        assert abs(r["base_score"] - sum(np.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws)) < 1e-6
        assert abs(r["score"] - want) < 1e-6


def test_katz_awkward_rows(docs, none):
    assert ngram_lm.score(docs, F.col("doc_id") > 3).count() == len(ROWS)
    untrained = ngram_lm.score(docs, F.lit(False)).collect()
    assert len(untrained) == len(ROWS) and all(np.isfinite(r["score"]) and r["n_known"] == 0 for r in untrained)
    assert ngram_lm.score(none, F.lit(True)).count() == 0


def test_whole_word_katz(spark, table, monkeypatch):
    monkeypatch.setattr(word_lm, "SPREAD", 20)
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_katz_scores"](spark, SF).collect()}
    tokens = {d: words(t) + [None] for d, t, _ in table}
    train = [d for d in tokens if zlib.crc32(str(d).encode()) % 10]
    count = collections.Counter(w for d in train for w in tokens[d])
    total, once = sum(count.values()), sum(n == 1 for n in count.values())
    assert total > 65_000  # rare words have bigrams of their own in tables of any size
    follow = collections.defaultdict(collections.Counter)
    for d in train:
        for a, b in zip(["", *tokens[d]], tokens[d]):
            follow[a][b] += 1
    few = collections.Counter(n for f in follow.values() for n in f.values())
    discount = ngram_lm.good_turing(np.array([few[i] for i in range(ngram_lm.CUT + 2)]))
    kept = lambda n: discount[n] * n if n <= ngram_lm.CUT else n
    share = lambda w: (count[w] or once) / (total + once)
    room, back = {}, {}
    for a, f in follow.items():
        whole, left = sum(f.values()), sum(map(kept, f.values()))
        room[a] = whole + (whole - left < 0.25)
        back[a] = (1 - left / room[a]) / (1 - sum(map(share, f)))
    for d, ws in tokens.items():
        want = sum(np.log10(kept(follow[a][b]) / room[a] if a in follow and b in follow[a] else back.get(a, 1.0) * share(b)) for a, b in zip(["", *ws], ws))
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in count for w in ws), total)
        assert abs(r["base_score"] - sum(np.log10((count[w] + 0.1) / (total + 0.1 * (len(count) + 1))) for w in ws)) < 1e-6
        assert abs(r["score"] - want) < 1e-6


def test_whole_word_katz_awkward_rows(docs, none):
    assert word_lm.score(docs, F.col("doc_id") > 3).count() == len(ROWS)
    untrained = word_lm.score(docs, F.lit(False)).collect()
    assert len(untrained) == len(ROWS) and all(np.isfinite(r["score"]) and r["n_known"] == 0 for r in untrained)
    assert word_lm.score(none, F.lit(True)).count() == 0


VECTORS = [(100, [1.0, 0.0, 0.5]), (200, [0.0, 0.0, 0.0]), (300, None), (1, [1.0, 0.1, 0.5]), (2, [1.0, 0.1, 0.5]), (3, [float("nan"), 0.0, 1.0]), (4, [None, 1.0, 1.0]), (5, [-1.0, 2.0, 0.25])]


def test_vectors(spark):
    table = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in nearest.nearest(vectors.usable(table)).orderBy("query_id", "rank").collect()]
    assert [(g[0], g[1], g[2]) for g in got] == [(100, 1, 1), (100, 2, 2), (100, 3, 5)]
    top = [tuple(r)[:3] for r in top_products(quantised(table)).orderBy("query_id", "rank").collect()]
    assert top == [(100, 1, 1), (100, 2, 2), (100, 3, 200), (100, 4, 5), (200, 1, 1), (200, 2, 2), (200, 3, 5), (200, 4, 100)]
    empty = table.where("vec_id < 0")
    assert nearest.nearest(vectors.usable(empty)).count() == 0 and top_products(quantised(empty)).count() == 0


def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = vectors.usable(table).toPandas().sort_values("vec_id")
    ids, v = x["vec_id"].to_numpy(), np.stack(x["v"])
    got = nearest.nearest(vectors.usable(table)).toPandas().groupby("query_id")["vec_id"].apply(set)
    hits = []
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((v - v[i]) ** 2).sum(1))
        d[i] = np.inf
        hits.append(len(got[ids[i]] & set(ids[np.lexsort((ids, d))[:10]].tolist())) / 10)
    assert np.mean(hits) >= 0.9


def test_shards(docs, none):
    got = sharding.shard(docs, 4).collect()
    assert len(got) == len(ROWS)
    for s in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots))) and len(slots) in (len(ROWS) // 4, -(-len(ROWS) // 4))
    texts = {r[0]: (r[1] or "").encode() for r in ROWS}
    assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]])) for r in got)
    assert sharding.shard(none).count() == 0
    for n in (1, 2, 3, 5, 17, 1000):
        assert sorted(sharding.permute(np.arange(n), n).tolist()) == list(range(n))


def test_mixing(spark, docs, none):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(table).collect()
    assert {r["doc_id"]: r["_tokens"] for r in rows} == {r["doc_id"]: len(words(r["text"])) for r in rows}
    whole = sum(r["_tokens"] for r in rows)
    assert abs(sum(r["_tokens"] * r["_probability"] for r in rows) - 0.7 * whole) < 1e-6 * whole
    for name in ("source", "lang", "_topic"):
        have, goal = collections.Counter(), collections.Counter()
        for r in rows:
            have[r[name]] += r["_tokens"] * r["_weight"]
            goal[r[name]] += r["_tokens"]
        want = mixing.tempered(dict(goal))
        assert all(abs(have[k] / whole - want[k]) < 1e-6 for k in want)
    assert mixing.mix(docs).count() == len(ROWS) and mixing.mix(none).count() == 0


def test_pipeline_stages(spark, docs, none):
    kept = corpus_pipeline.language_stage(spark, docs, SF)
    assert kept.columns == docs.columns and {1, 2, 10}.isdisjoint({r["doc_id"] for r in kept.collect()})
    single = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    want = {root for _, root in brute_components([(r[0], r[1]) for r in ROWS], 5, 80).values()}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(want)
    assert corpus_pipeline.suffix_stage(spark, docs, SF).columns == docs.columns
    frame = none
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF)
    assert frame.count() == 0
    assert corpus_pipeline.run(spark, SF).count() > 0
