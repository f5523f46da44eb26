"""Operators whose work or disk was over its limit: what made it so must not come back."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_operators import brute_removed
from textlake.llm import ngram_join, packing, queries, suffix_dedup
from textlake.llm.blocks import part_keys, text_bytes


class Counted:
    """A tokenizer that counts the strings it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.strings = tokenizer, 0

    def encode_batch_fast(self, texts, add_special_tokens):
        self.strings += len(texts)
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=add_special_tokens)


def test_new_words_are_encoded_together():
    encoder = packing.WordEncoder(queries.tokenizer_path())
    encoder.tokenizer = Counted(encoder.tokenizer)
    words = [f"w{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    text = " ".join(w + s for w in words for s in ["", ".", ",", "!?"])
    ids, at = encoder.encode(*text_bytes(pa.array([text, None])))
    assert encoder.tokenizer.strings <= len(words) // 20
    assert len(encoder.size) == len(words) + 3  # a word before a stop is the same word
    assert at.tolist() == [0, len(ids), len(ids)]
    assert ids.tolist() == encoder.tokenizer.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kept", [20, 500_000])
def test_words_have_the_ids_of_the_whole_text(kept, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", kept)
    encoder, some = packing.WordEncoder(queries.tokenizer_path()), random.Random(3)
    atoms = [*"abzAZ'.,;:!?\x01\x00 \n\t|<>09\u00e9\u03a3\u03c3\u0130\u00df\u0301\u0338\u00a0\u2014\u4f60", "'s", "'RE", " \x01 ", "n't", "x.y", "<|endoftext|>", "<|ENDOFTEXT|>"]
    for _ in range(20):
        texts = ["".join(some.choice(atoms) for _ in range(some.randrange(60))) for _ in range(30)]
        ids, at = encoder.encode(*text_bytes(pa.array(texts)))
        assert [x.tolist() for x in np.split(ids, at[1:-1])] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_copies_end_at_the_first_shuffle(spark):
    texts = ["one two three four five six seven"] * 20 + ["One  two three four five six SEVEN", "another text of seven words is here", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sum(len(r["gram"]) for r in ngram_join._shared_grams(docs, part_keys(spark), 4).collect()) == 0
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(docs).collect())
    assert got == [(i, 4, 0) for i in range(21)] + [(21, 4, 21), (22, 0, 22), (23, 0, 23)]


def test_sets_are_named_by_their_smallest_document(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:-1], "z"])
    texts = [(7, " ".join(words)), (3, near), (9, " ".join(words)), (5, near), (1, "w0 w1 w2 w3 w4"), (8, " ".join(words[::-1]))]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {7: 3, 3: 3, 9: 3, 5: 3, 1: 1, 8: 8}


@pytest.mark.parametrize("hot", [2, 30])
def test_contexts_of_a_frequent_anchor_meet_by_one_side(hot, spark, monkeypatch):
    # before, every context of an anchor with more than HOT of them was sent as 33 windows
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    some = random.Random(5)
    noise = lambda n: "".join(some.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    tails = [noise(40) for _ in range(8)]
    rows = [(i, f"{noise(70)}an anchor of many texts{tails[i % 8] if i % 2 else noise(40)}{noise(30)}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = docs.selectExpr("doc_id", "crc32(text) AS tag", "text")
    found = suffix_dedup._find_repeats(known, part_keys(spark), 50).collect()
    sent = {k: sum(len(r["doc"]) // 8 for r in found if r["kind"] == k) for k in (suffix_dedup._CHECK, suffix_dedup._HOT)}
    assert sent[suffix_dedup._CHECK] > 0 and (sent[suffix_dedup._HOT] > 0) == (hot == 2)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.removed_spans(docs).collect()}
    assert got == brute_removed(rows) and any(r[1] for r in got.values())


def test_shingles_of_many_parts_travel_without_their_sets_names(spark):
    # before, each took 20 bytes where every shingle of a set goes to another part
    some = random.Random(9)
    texts = [" ".join(f"w{some.randrange(10 ** 6)}" for _ in range(203)) for _ in range(300)]
    texts = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[i]) for i in range(20)] + [(2000 + i, texts[i + 30][:-3] + " x") for i in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(1)
    keys = np.arange(5000, dtype=np.int32)
    own = ngram_join._profile(docs, 4)
    copied = spark.sparkContext.broadcast(ngram_join._screen(own, part_keys(spark), 2, ngram_join.SCREEN_BITS, ngram_join._set_names))
    assert ngram_join._width(5000) == 6 and ngram_join._width(102) == 7 and ngram_join._width(2) == 8
    emitted = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ngram_join, "exchange", lambda df, keys, fn, schema: emitted.append(df) or df)
        ngram_join._shared_grams(docs, keys, 4, copied)
    rows = [r for r in emitted[0].collect() if not r["name"]]
    n = sum(len(r["number"]) for r in rows)
    assert n == 340 * 200 + 20
    assert sum(len(r[c]) for r in rows for c in ("gram", "home", "times", "number")) < 14 * n  # chunks as small as this one share a home with few
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {**{i: i for i in range(300)}, **{1000 + i: i for i in range(20)}, **{2000 + i: 30 + i for i in range(20)}}


def test_homes_tell_all_sets_apart():
    name, copied = np.arange(10, 2010), np.arange(2000) % 5 == 0
    home, number = ngram_join._homes(name, copied)
    assert len(set(zip(home.tolist(), number.tolist()))) == 2000 and (home[copied] == name[copied]).all()
    assert len(set(home[~copied].tolist())) == -(-1600 // 256)
    gram = np.array([0, 1, 2 ** 64 - 1, 2 ** 63 + 12345], np.uint64)
    for parts in (2, 7, 300):
        for g in gram:
            again = ngram_join._unpacked(ngram_join._packed(np.array([g]), parts).tobytes(), int(g) % parts, parts)[0]
            bits = 8 * ngram_join._width(parts)
            assert int(again) == int(g) // parts % 2 ** bits * parts + int(g) % parts


def test_suffixes_that_meet_are_ranked_as_in_the_whole_array():
    data = np.random.default_rng(1).integers(0, 3, 600).astype(np.uint8)
    data[300:500] = data[:200]
    some = np.arange(0, 550, 2)
    want = np.unique(suffix_dedup.suffix_ranks(data, 50)[some], return_inverse=True)[1]
    assert suffix_dedup.ranks_of(data, some, 50).tolist() == want.tolist() and want.max() < len(some) - 1
