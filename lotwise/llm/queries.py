"""The dealt operators over their whole tables, one query each, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import byte_bpe, hnsw, line_labels, mixing, phrases, quality, repair, sharding, simhash, token_count, vector_dedup, warc, whitening
from lotwise.sources.tables import Tables


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_pages(Tables(spark, sf_dir).pages)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(Tables(spark, sf_dir).embeddings)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(Tables(spark, sf_dir).documents, _vocabulary("piece_bpe_32k.model"))


def op4_sampled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the law `bytes`."""
    rows = sharding.shard_records(Tables(spark, sf_dir).documents)
    return rows.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_grammar_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.round_trip(Tables(spark, sf_dir).documents, _vocabulary("word_bpe_49k.json"))


def op6_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = Tables(spark, sf_dir).embeddings
    return hnsw.search(hnsw.build_index(vectors), vectors.where("vec_id % 20 = 0"))


def op7_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = _vocabulary("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(Tables(spark, sf_dir).documents, path, public_tokenizers.PATTERN)
    return byte_bpe.digests(encoded, path)


def op8_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(Tables(spark, sf_dir).documents)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(Tables(spark, sf_dir).documents).drop("source")


def op10_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return quality.classify(t.documents, t.labels)


def op11_phrase_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(Tables(spark, sf_dir).documents)


def op12_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return line_labels.keep_content(t.documents, t.labels)


def op13_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(Tables(spark, sf_dir).embeddings)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc_revisits, op2_vector_dedup, op3_token_counts, op4_sampled_shards, op5_grammar_ids, op6_graph_search,
        op7_distinct_word_bpe, op8_simhash_variants, op9_source_mix, op10_subword_quality, op11_phrase_bounds, op12_line_field,
        op13_lanczos_whitening,
    )
}

SQL: dict[str, str] = {
    "op1_warc_revisits": """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages),
 f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
 CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100""",
    "op2_vector_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
 link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98),
 reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
 n AS (SELECT a, count(*) AS n FROM link GROUP BY a),
 c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, c.c = v.vec_id AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id""",
    "op11_phrase_bounds": """
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang,
  string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS p FROM documents),
 piece AS (SELECT i, lang, unnest(p) AS p, generate_subscripts(p, 1) AS k FROM d),
 word AS (SELECT i, lang, k, unnest(string_split_regex(p, '[\\x20\\x09]+')) AS w, generate_subscripts(string_split_regex(p, '[\\x20\\x09]+'), 1) AS j FROM piece),
 t AS MATERIALIZED (SELECT lang, w AS w1, lead(w) OVER z AS w2, lead(w, 2) OVER z AS w3 FROM word WHERE w <> '' WINDOW z AS (PARTITION BY i, k ORDER BY j)),
 f1 AS MATERIALIZED (SELECT lang, w1, count(*) AS f FROM t GROUP BY ALL),
 f2 AS MATERIALIZED (SELECT lang, w1, w2, count(*) AS f FROM t WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
 f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*) AS f FROM t WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
 n AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
 s AS (SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, x.f AS l, y.f AS r, 1 AS k FROM f2
   JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
  UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, x.f, y.f, 1 FROM f3
   JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
  UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, x.f, y.f, 2 FROM f3
   JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3),
 z AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM s),
 b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 g AS (SELECT lang, phrase, max(f) AS a FROM (SELECT lang, f, w1 || ' ' || w2 AS phrase FROM f3 UNION ALL SELECT lang, f, w2 || ' ' || w3 FROM f3) GROUP BY ALL),
 c AS (SELECT b.* FROM b LEFT JOIN g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.a IS NULL OR 100 * g.a < 50 * b.a),
 q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c)
SELECT q.lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM q JOIN n ON n.lang = q.lang WHERE rank <= 2000""",
}
