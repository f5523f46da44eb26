"""Bounded raking against its targets, and searches over vectors of several lengths against brute force."""

import collections
import itertools

import numpy as np

from textlake.llm import mixing, nearest, vectors
from textlake.llm.block_topk import quantised, top_products


def test_mixing_meets_attainable_targets():
    rng = np.random.default_rng(3)
    keys = [(s, l, t) for s in "abcd" for l in ("en", "de", None) for t in ("prose", "legal")]
    tokens = np.where(rng.random(len(keys)) < 0.2, 0, 10 ** rng.uniform(0, 5, len(keys))).round()
    # targets of some sample are attainable by construction, though raking alone would ask cells for more than they hold
    kept = tokens * np.minimum(1, rng.uniform(0, 1.6, len(keys)))
    share = kept.sum() / tokens.sum()
    targets = [{v: kept[[k[d] == v for k in keys]].sum() for v in {k[d] for k in keys}} for d in range(3)]
    plain = mixing.rake(keys, tokens, targets) * share
    assert (plain > tokens * (1 + 1e-6)).any()
    got = mixing.bounded(keys, tokens, targets, share)
    assert (got <= tokens * (1 + 1e-12)).all()
    for d, target in enumerate(targets):
        for v, want in target.items():
            assert abs(got[[k[d] == v for k in keys]].sum() - want) < 1e-6 * kept.sum()


def test_mixing_lowers_targets_to_what_there_is():
    assert mixing.attainable(np.array([1.0, 1.0, 2.0]), np.array([10.0, 1000.0, 1000.0]), 400).round(9).tolist() == [10.0, 130.0, 260.0]
    assert mixing.attainable(np.array([1.0, 0.0]), np.array([5.0, 9.0]), 12).tolist() == [5.0, 0.0]
    assert mixing.bounded([("a",), ("b",)], np.zeros(2), [{"a": 1.0}], 0.5).tolist() == [0.0, 0.0]
    assert mixing.bounded([("a",), ("b",)], np.array([4.0, 4.0]), [{"a": 1.0, "b": 3.0}], 1.0).tolist() == [4.0, 4.0]


def test_expected_shares_of_the_corpus(spark):
    rows = mixing.mix(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    whole, chances = sum(r["_tokens"] for r in rows), {r["_probability"] for r in rows}
    assert 1.0 in chances
    for name in ("source", "lang", "_topic"):
        have, expected = collections.Counter(), collections.Counter()
        for r in rows:
            have[r[name]] += r["_tokens"]
            expected[r[name]] += r["_tokens"] * r["_probability"]
        values = list(have)
        goal = mixing.tempered(dict(have))
        want = mixing.attainable(np.array([goal[v] for v in values]), np.array([float(have[v]) for v in values]), 0.7 * whole)
        assert max(abs(expected[v] - w) for v, w in zip(values, want)) < 1e-6 * whole


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4 if i % 3 else 7).tolist()) for i in range(330)] + [(400, [1.0]), (401, None), (402, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    usable = {i: np.array(v) for i, v in rows if v}
    near, top = {}, {}
    for q in (i for i in usable if i % 100 == 0):
        same = [i for i in usable if i != q and len(usable[i]) == len(usable[q])]
        near[q] = sorted(same, key=lambda i: (np.sqrt(((usable[i] - usable[q]) ** 2).sum()), i))[:10]
        top[q] = sorted(same, key=lambda i: (-int((np.floor(usable[i] * 1024) * np.floor(usable[q] * 1024)).sum()), i))[:10]
    found = lambda df: {q: [r["vec_id"] for r in sorted(rs, key=lambda r: r["rank"])] for q, rs in itertools.groupby(
        sorted(df.collect(), key=lambda r: r["query_id"]), key=lambda r: r["query_id"])}
    assert found(top_products(quantised(table))) == {q: ids for q, ids in top.items() if ids}
    got = found(nearest.nearest(vectors.usable(table)))
    assert got.keys() == {q for q, ids in near.items() if ids}
    assert all(len(usable[i]) == len(usable[q]) for q, ids in got.items() for i in ids)
    assert sum(len({*near[q]} & {*ids}) for q, ids in got.items()) >= 0.9 * sum(len(ids) for ids in near.values())
