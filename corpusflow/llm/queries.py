"""The operators bound to the tables of a data directory: one ``opN_<name>``
query each, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import split_of
from .vectors import usable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(_table(spark, sf_dir, "documents"), limit_bytes=SHARD_BYTES)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), capacity=2048, end_id=0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    labels = _table(spark, sf_dir, "labels").where(split_of(F.col("doc_id"), 3) != 1).select("doc_id", "toxic")
    out = score_toxicity(_table(spark, sf_dir, "documents"), labels)
    held_out = F.coalesce(split_of(F.col("doc_id"), 3) == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import score

    docs = _table(spark, sf_dir, "documents")
    out = score(docs.select("doc_id", "text"), docs.where(split_of(F.col("doc_id"), 7) != 2).select("text"))
    held_out = F.coalesce(split_of(F.col("doc_id"), 7) == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_join import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import read_token_files, write_token_files

    return read_token_files(spark, write_token_files(_table(spark, sf_dir, "documents"), seq_len=2048, end_id=1))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, train

    docs = _table(spark, sf_dir, "documents")
    model = train(docs.where(split_of(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(split_of(F.col("doc_id"), 4) == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .knn import top_k

    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * 256).cast("double")).alias("x"), "embedding")
    rows = rows.where(F.coalesce(usable("embedding"), F.lit(False)))  # floor would make integers of what is not finite
    return top_k(rows.select("vec_id", "x"), rows.where(F.col("vec_id") % 50 == 0).select("vec_id", "x"), k=5)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.0, most=3.0).drop("first_taken")


def op11_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .windows import rolling_features

    return rolling_features(_table(spark, sf_dir, "documents"), windows=(3600, 21600))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(_table(spark, sf_dir, "documents"), least=30, longest=4, best=2000)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .leaks import decontaminate

    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), n=10)


#: Bytes of text in a shard.
SHARD_BYTES = 1 << 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sharding, op2_packing, op3_toxicity, op4_ngram_join, op5_lm_scoring, op6_embedding_join, op7_token_files, op8_language, op9_top_k, op10_mixing, op11_rolling, op12_collocations, op13_decontamination)
}

_USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0"

#: Plain SQL of the queries that SQL can express: all pairs, all paths.
ORACLE_SQL: dict[str, str] = {
    "op1_sharding": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS bytes, ('0x'||substr(md5('17:'||doc_id), 1, 8))::BIGINT AS h FROM documents),
p AS (SELECT r, doc_id, bytes, bits, (1::BIGINT << bits) + (h >> (32 - bits)) AS shard_id FROM d, (SELECT unnest(range(0, 33)) AS bits)),
s AS (SELECT bits, shard_id, sum(bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_rows FROM p GROUP BY 1, 2),
f AS (SELECT r, min(bits) AS bits FROM p JOIN s USING (bits, shard_id) WHERE shard_bytes <= {SHARD_BYTES} OR shard_rows = 1 GROUP BY 1)
SELECT doc_id, bytes, shard_id, bits::INT AS local_depth, shard_bytes, shard_rows, shard_bytes > {SHARD_BYTES} AS oversize FROM f JOIN p USING (r, bits) JOIN s USING (bits, shard_id)""",
    "op4_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i]||' '||w[i+1]||' '||w[i+2])) END AS g FROM w),
s AS (SELECT doc_id, unnest(g) AS s FROM g), n AS (SELECT doc_id, len(g)::BIGINT AS n FROM g),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r(v, w) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.w)
SELECT n.doc_id, n.n AS n_shingles, min(r.w) AS component_id FROM n JOIN r ON r.v = n.doc_id GROUP BY 1, 2""",
    "op6_embedding_join": f"""
WITH RECURSIVE u AS (SELECT vec_id, embedding::DOUBLE[] AS x, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings WHERE {_USABLE}),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.x, b.x) / (a.n * b.n) >= 0.9),
r(v, w) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.w),
c AS (SELECT v, min(w) AS c FROM r GROUP BY 1), k AS (SELECT a, count(*) AS k FROM l GROUP BY 1)
SELECT e.vec_id, coalesce(k.k, 0)::BIGINT AS n_links, c.c AS component_id, e.vec_id = c.c AS kept FROM embeddings e JOIN c ON c.v = e.vec_id LEFT JOIN k ON k.a = e.vec_id""",
    "op9_top_k": f"""
WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS x FROM embeddings WHERE {_USABLE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM x q JOIN x c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5""",
    "op11_rolling": """
WITH t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
h AS (SELECT doc_id, source, lang, length(text)::BIGINT AS n, xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS h FROM documents, t),
e AS (SELECT row_number() OVER () AS r, doc_id, source, lang, n, (60 * floor((doc_id + h % 4000) / 6))::BIGINT AS event_s FROM h),
j AS (SELECT a.r, w.window_s::BIGINT AS window_s, b.n, b.lang, b.r AS o FROM e a, (VALUES (3600), (21600)) w(window_s) JOIN e b ON b.source IS NOT DISTINCT FROM a.source AND b.event_s >= a.event_s - w.window_s AND b.event_s < a.event_s),
g AS (SELECT r, window_s, count(*) AS n_events, coalesce(sum(n), 0)::BIGINT AS sum_chars, count(DISTINCT lang) AS n_langs, list_sort(list(n) FILTER (n IS NOT NULL)) AS l FROM j GROUP BY 1, 2)
SELECT e.doc_id, w.window_s::BIGINT AS window_s, e.event_s, coalesce(g.n_events, 0)::BIGINT AS n_events, coalesce(g.sum_chars, 0)::BIGINT AS sum_chars, coalesce(g.n_langs, 0)::BIGINT AS n_langs, l[(len(l) + 1) // 2]::BIGINT AS median_chars, l[(75 * len(l) + 99) // 100]::BIGINT AS high_chars
FROM e CROSS JOIN (VALUES (3600), (21600)) w(window_s) LEFT JOIN g ON g.r = e.r AND g.window_s = w.window_s""",
    "op12_collocations": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT row_number() OVER () AS p, lang, s FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS s FROM d)),
u AS (SELECT p, lang, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT p, lang, list_filter(string_split_regex(s, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p)),
t AS (SELECT lang, count(*)::BIGINT AS n FROM u GROUP BY 1),
v AS (SELECT lang, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c, lead(w, 3) OVER o AS d FROM u WINDOW o AS (PARTITION BY p ORDER BY i)),
g AS (SELECT lang, 1 AS k, a AS phrase FROM v UNION ALL SELECT lang, 2, a||' '||b FROM v WHERE b IS NOT NULL UNION ALL SELECT lang, 3, a||' '||b||' '||c FROM v WHERE c IS NOT NULL UNION ALL SELECT lang, 4, a||' '||b||' '||c||' '||d FROM v WHERE d IS NOT NULL),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
s AS (SELECT c.lang, c.k, c.phrase, c.a, x.i AS cut, l.a AS l, r.a AS r, ((2000000::HUGEINT * c.a) // (l.a + r.a))::BIGINT AS score
  FROM c JOIN range(1, 4) x(i) ON x.i < c.k JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:x.i], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[x.i + 1:c.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT c.lang, array_to_string(c.w[j.j:j.j + m.m - 1], ' ') AS phrase, max(c.a) AS most FROM c, range(2, 4) m(m), range(1, 4) j(j) WHERE m.m < c.k AND j.j + m.m - 1 <= c.k GROUP BY 1, 2),
o AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE i.most IS NULL OR 100 * i.most < 80 * b.a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT q.lang, q.rank::BIGINT AS rank, q.phrase, q.a::BIGINT AS a, q.l::BIGINT AS l, q.r::BIGINT AS r, t.n, q.score FROM q JOIN t USING (lang) WHERE q.rank <= 2000""",
    "op13_decontamination": r"""
WITH low AS (SELECT 0 AS kind, row_number() OVER () AS r, doc_id AS id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), item_id, text FROM benchmark),
w AS (SELECT kind, r, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT id, least(10, len(w)) AS k, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS g FROM w WHERE kind = 1 AND len(w) > 0),
d AS (SELECT r, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM w JOIN (SELECT DISTINCT k FROM b) ON len(w) >= k WHERE kind = 0),
m AS (SELECT d.r, d.i, d.k, b.id FROM d JOIN b ON b.k = d.k AND b.g = d.g),
h AS (SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM m)) GROUP BY 1),
x AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, id::VARCHAR AS s FROM m WHERE id IS NOT NULL) GROUP BY 1)
SELECT w.id AS doc_id, len(w.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(x.n_items, 0)::BIGINT AS n_items, sha256(coalesce(x.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (r) LEFT JOIN x USING (r) WHERE w.kind = 0""",
}
