"""Registered queries of the training-data operators, with SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm import block_topk, collocations, conversation_trie, language, license, mixing, nearest, ngram_join, packing, sharding, suffix_dedup, toxicity, vectors, word_lm

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int):
    """crc32(doc_id as text) mod n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_best_fit_packing")
def best_fit_packing(spark, sf_dir):
    return packing.best_fit(packing.pieces(_table(spark, sf_dir, "documents"), tokenizer_path()))


@query("op5_license_scan")
def license_scan(spark, sf_dir):
    return license.scan(_table(spark, sf_dir, "documents"))


@query("op7_language_id")
def language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs, remainder(3) != 1)
    found = language.identify(docs, model)
    return found.select("doc_id", (F.coalesce(remainder(3), F.lit(0)) == 1).alias("held_out"), "lang_pred", "score", "accepted")


@query("op9_feistel_shards")
def feistel_shards(spark, sf_dir):
    return sharding.shard(_table(spark, sf_dir, "documents"))


@query("op1_ngram_jaccard_join", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.r)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id
FROM w JOIN reach ON reach.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id""")
def ngram_jaccard_join(spark, sf_dir):
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


@query("op10_suffix_dedup", """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, CAST(len(h) / 2 AS BIGINT))) AS i FROM b),
x AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS byte, CASE WHEN 2 * i + 100 <= len(h) THEN substr(h, 2 * i + 1, 100) END AS g FROM p),
f AS (SELECT g, min(doc_id) AS first FROM x WHERE g IS NOT NULL GROUP BY g),
m AS (SELECT x.doc_id, i, byte, CAST(coalesce(first < x.doc_id, false) AS INTEGER) AS dup FROM x LEFT JOIN f USING (g)),
c AS (SELECT doc_id, i, byte, max(dup) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m),
r AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS head FROM c),
t AS (SELECT doc_id, count(*) AS n, sum(gone) AS removed, count(*) FILTER (head) AS spans, string_agg(byte, '' ORDER BY i) FILTER (gone = 0) AS kept FROM r GROUP BY doc_id)
SELECT b.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM b LEFT JOIN t USING (doc_id)""")
def suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.removed_spans(_table(spark, sf_dir, "documents"))


@query("op6_katz_scores")
def katz_scores(spark, sf_dir):
    return word_lm.score(_table(spark, sf_dir, "documents"), remainder(10) != 0)


@query("op3_cross_polytope_search")
def cross_polytope_search(spark, sf_dir):
    return nearest.nearest(vectors.usable(_table(spark, sf_dir, "embeddings")))


@query("op8_block_top_k", """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.x, d.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM x q JOIN x d ON d.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""")
def block_top_k(spark, sf_dir):
    return block_topk.top_products(block_topk.quantised(_table(spark, sf_dir, "embeddings")))


@query("op4_mixing")
def mixing_to_targets(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return mixing.mix(docs).select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"),
                                   F.col("_weight").alias("weight"), F.col("_probability").alias("probability"), F.col("_kept").alias("kept"))


@query("op11_collocations", r"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
                  string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM t),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase
      FROM p, range(1, 6) AS r(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS cutat FROM c),
s AS (SELECT cut.lang, cut.phrase, a, cutat, l.f AS l, r.f AS r, n, CAST((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score FROM cut
      JOIN f l ON l.lang = cut.lang AND l.k = cutat AND l.phrase = array_to_string(list_slice(w, 1, cutat), ' ')
      JOIN f r ON r.lang = cut.lang AND r.k = cut.k - cutat AND r.phrase = array_to_string(list_slice(w, cutat + 1, cut.k), ' ')
      JOIN n ON n.lang = cut.lang),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cutat) = 1),
kept AS (SELECT * FROM low WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = low.lang AND len(c.phrase) > len(low.phrase)
         AND contains(' ' || c.phrase || ' ', ' ' || low.phrase || ' ') AND 100 * c.a >= 100 * low.a)),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM kept)
SELECT * FROM o WHERE rank <= 2000""")
def phrase_collocations(spark, sf_dir):
    return collocations.collocations(_table(spark, sf_dir, "documents").select("text", "lang"))


@query("op12_prefix_trie", """
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(coalesce(role, '')), encode(coalesce(text, ''))) AS i,
                  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id AS c, conv_id - conv_id % 5 AS base, count(*) AS n,
             xor(list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                             lambda a, b: list_reduce([xor(a, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 9 AS h
      FROM o GROUP BY conv_id),
t AS (SELECT s.*, least(s.h, coalesce(b.n, 0)) AS led FROM s LEFT JOIN s b ON b.c = s.base),
r AS (SELECT c, i AS d, role, text FROM t JOIN o ON o.conv_id = base AND i <= h
      UNION ALL SELECT c, led + i - h, role, text FROM t JOIN o ON o.conv_id = c AND i > h),
l AS (SELECT t.c, coalesce(max(d), 0) AS len FROM t LEFT JOIN r USING (c) GROUP BY t.c),
p AS MATERIALIZED (SELECT c, d, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY c ORDER BY d) AS key, strlen(text) AS bytes FROM r UNION ALL SELECT c, 0, '', 0 FROM t),
n AS MATERIALIZED (SELECT d, key, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY d, key),
k AS (SELECT d - 1 AS d, substr(key, 1, 64 * (d - 1)) AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
u AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (d, key)),
b AS (SELECT p.d, p.key, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.bytes) AS saved FROM u JOIN p ON p.c = u.conv_id AND p.d <= u.d GROUP BY ALL),
e AS (SELECT d, key, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM p JOIN l USING (c) WHERE d = len GROUP BY ALL)
SELECT u.conv_id, u.d AS depth, up.conv_id AS parent_conv_id, u.n_convs, u.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       coalesce(ends, sha256('')) AS ends_sha256
FROM u JOIN b USING (d, key) LEFT JOIN e USING (d, key) LEFT JOIN n up ON up.d = u.d - 1 AND up.key = substr(u.key, 1, 64 * (u.d - 1))""")
def prefix_trie(spark, sf_dir):
    return conversation_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


@query("op13_toxicity")
def toxicity_scores(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"), remainder(5) != 0)
    return toxicity.score(docs, model).select("doc_id", (F.coalesce(remainder(5), F.lit(1)) == 0).alias("held_out"), "score", "predicted")
