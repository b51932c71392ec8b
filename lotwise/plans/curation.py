"""Inventories, duplicates and collisions of source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions import core as fn
from lotwise.operators import curate as U
from lotwise.plans.registry import query
from lotwise.plans.sqltext import DOCS, EMB, LOTS, r6

LANGS = ["de", "en", "es", "fr"]


@query("count_pivot", f"SELECT source, {', '.join(f'''count(*) FILTER (WHERE lang='{x}') AS {x}''' for x in LANGS)}, count(*) AS total FROM documents GROUP BY source")
def count_pivot(t):
    p = t.documents.groupBy("source").pivot("lang", LANGS).count().na.fill(0)
    return p.withColumn("total", sum((F.col(x) for x in LANGS[1:]), F.col(LANGS[0])))


@query("count_rollup", "SELECT source, lang, count(*) AS n FROM documents GROUP BY ROLLUP (source, lang)")
def count_rollup(t):
    return t.documents.rollup("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_groups", f"WITH {LOTS} SELECT source, count(DISTINCT photo) AS photos FROM lots GROUP BY source")
def distinct_groups(t):
    pairs = t.lots().select("source", "photo").distinct()  # distinct first: a hot source is spread over its photos
    return pairs.groupBy("source").agg(F.count(F.lit(1)).alias("photos"))


@query("raw_vs_unique", f"WITH {DOCS} SELECT source, lang, count(*) AS files, count(DISTINCT m) AS uniq FROM docs GROUP BY source, lang")
def raw_vs_unique(t):
    c = t.docs().groupBy("source", "lang", "m").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("source", "lang").agg(F.sum("n").alias("files"), F.count(F.lit(1)).alias("uniq"))


@query("uniqueness", f"WITH {DOCS} SELECT count(*) AS rows, count(DISTINCT m) AS files, count(DISTINCT c) AS crops, count(*) = count(DISTINCT m) AS proven FROM docs")
def uniqueness(t):
    d = t.docs().select("m", "c")
    per = d.groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    crops = d.select("c").distinct().agg(F.count(F.lit(1)).alias("crops"))
    x = per.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("files"))
    return x.select("rows", "files", crops.scalar().alias("crops"), (F.col("rows") == F.col("files")).alias("proven"))


@query("label_conflicts", """WITH h AS (SELECT md5(text) AS m, count(*) AS copies, count(DISTINCT lang||coalesce(CAST(quality AS VARCHAR),'-')) AS labels FROM documents LEFT JOIN labels USING (doc_id) GROUP BY md5(text))
 SELECT m, copies, labels FROM h WHERE labels > 1""")
def label_conflicts(t):
    x = t.documents.select("doc_id", F.md5("text").alias("m"), "lang").join(t.labels, "doc_id", "left")
    c = x.groupBy("m", F.concat("lang", F.coalesce(F.col("quality").cast("string"), F.lit("-"))).alias("lab")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("m").agg(F.sum("n").alias("copies"), F.count(F.lit(1)).alias("labels")).where("labels > 1")


@query("build_log", """WITH e AS (SELECT doc_id, source, n_chars, n_chars < 200 AS bad, row_number() OVER (PARTITION BY source, n_chars < 200 ORDER BY doc_id) AS rn FROM documents)
 SELECT source, count(*) AS items, count(*) FILTER (WHERE NOT bad) AS rows, count(*) FILTER (WHERE bad) AS errors, CAST(coalesce(sum(n_chars) FILTER (WHERE NOT bad),0) AS BIGINT) AS chars,
 coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (WHERE bad AND rn <= 5),'') AS examples FROM e GROUP BY source""")
def build_log(t):
    from lotwise.operators.splits import first_k

    d = t.documents.select("doc_id", "source", "n_chars", (F.col("n_chars") < 200).alias("bad"))
    agg = d.groupBy("source").agg(F.count(F.lit(1)).alias("items"), F.count_if(~F.col("bad")).alias("rows"), F.count_if("bad").alias("errors"),
                                  F.coalesce(F.sum(F.when(~F.col("bad"), F.col("n_chars"))), F.lit(0)).alias("chars"))
    ex = first_k(d.where("bad"), ["source"], [F.col("doc_id")], 5).groupBy("source").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("examples"))
    return agg.join(ex, "source", "left").withColumn("examples", F.coalesce("examples", F.lit("")))


@query("declared_vs_found", """WITH d AS (SELECT o_orderkey AS photo, CAST(floor(o_totalprice/100000)+1 AS BIGINT) AS declared FROM orders), f AS (SELECT l_orderkey AS photo, count(*) AS found FROM lineitem GROUP BY 1)
 SELECT declared, coalesce(found,0)-declared AS gap, count(*) AS photos FROM d LEFT JOIN f USING (photo) GROUP BY 1, 2""")
def declared_vs_found(t):
    d = t.orders.select(F.col("o_orderkey").alias("photo"), (F.floor(F.col("o_totalprice") / 100000) + 1).alias("declared"))
    f = t.lineitem.groupBy(F.col("l_orderkey").alias("photo")).agg(F.count(F.lit(1)).alias("found"))
    gap = F.coalesce("found", F.lit(0)) - F.col("declared")
    return d.join(f, "photo", "left").groupBy("declared", gap.alias("gap")).agg(F.count(F.lit(1)).alias("photos"))


def deduped(t):
    """Documents of 20 sources in source order; two documents in a row are one file, the benchmark is the reference."""
    d = t.docs().select("doc_id", "source_no", F.floor(F.col("doc_id") / 40).alias("path"), "m", "c")
    ref = t.benchmark.select(F.md5("text").alias("m"), F.md5(F.regexp_replace("text", r"[ \n\t]+", " ")).alias("c"))
    return U.precedence_dedupe(d, ref, source="source_no", order="doc_id", path="path", src_hash="m", crop_hash="c")


DEDUPE_SQL = f"""{DOCS}, rows0 AS (SELECT doc_id, source_no, doc_id//40 AS path, m, c FROM docs), rws AS (SELECT *, path <> first_value(path) OVER (PARTITION BY source_no, m ORDER BY doc_id) AS other FROM rows0),
 ref AS (SELECT coalesce(list(md5(text)),[]) AS rm, coalesce(list(md5(regexp_replace(text, '[ \\n\\t]+', ' ', 'g'))),[]) AS rc FROM benchmark),
 st AS (SELECT 0 AS k, rm AS seen_m, rc AS seen_c, CAST([] AS BIGINT[]) AS kept FROM ref UNION ALL
  SELECT k+1, list_concat(seen_m, nm), list_concat(seen_c, nc), list_concat(kept, nk) FROM (SELECT st.k, st.seen_m, st.seen_c, st.kept,
   (SELECT coalesce(list(m),[]) FROM rws r WHERE r.source_no=st.k AND NOT list_contains(st.seen_m, r.m) AND NOT r.other AND NOT list_contains(st.seen_c, r.c)
      AND NOT EXISTS (SELECT 1 FROM rws q WHERE q.source_no=r.source_no AND q.c=r.c AND q.doc_id < r.doc_id AND NOT q.other AND NOT list_contains(st.seen_m, q.m))) AS nm,
   (SELECT coalesce(list(c),[]) FROM rws r WHERE r.source_no=st.k AND NOT list_contains(st.seen_m, r.m) AND NOT r.other AND NOT list_contains(st.seen_c, r.c)
      AND NOT EXISTS (SELECT 1 FROM rws q WHERE q.source_no=r.source_no AND q.c=r.c AND q.doc_id < r.doc_id AND NOT q.other AND NOT list_contains(st.seen_m, q.m))) AS nc,
   (SELECT coalesce(list(doc_id),[]) FROM rws r WHERE r.source_no=st.k AND NOT list_contains(st.seen_m, r.m) AND NOT r.other AND NOT list_contains(st.seen_c, r.c)
      AND NOT EXISTS (SELECT 1 FROM rws q WHERE q.source_no=r.source_no AND q.c=r.c AND q.doc_id < r.doc_id AND NOT q.other AND NOT list_contains(st.seen_m, q.m))) AS nk
   FROM st WHERE st.k < 20)),
 fin AS (SELECT unnest(kept) AS doc_id FROM st WHERE k=20), kp AS (SELECT r.* FROM rws r JOIN fin USING (doc_id)),
 lab AS (SELECT r.doc_id, r.source_no, CASE WHEN list_contains(rm, r.m) OR EXISTS (SELECT 1 FROM kp WHERE kp.m=r.m AND kp.source_no < r.source_no) THEN 'src_cross' WHEN other THEN 'src_within'
  WHEN list_contains(rc, r.c) OR EXISTS (SELECT 1 FROM kp WHERE kp.c=r.c AND kp.source_no < r.source_no) THEN 'crop_cross' WHEN EXISTS (SELECT 1 FROM kp WHERE kp.c=r.c AND kp.source_no=r.source_no AND kp.doc_id < r.doc_id) THEN 'crop_within' ELSE '' END AS reason FROM rws r, ref)"""


@query("exact_dedupe", f"WITH RECURSIVE {DEDUPE_SQL} SELECT doc_id, source_no, reason = '' AS keep, reason FROM lab")
def exact_dedupe(t):
    return deduped(t).select("doc_id", "source_no", "keep", "reason")


@query("dedupe_stats", f"""WITH RECURSIVE {DEDUPE_SQL} SELECT source_no, count(*) AS rows_in, count(*) FILTER (WHERE reason='src_within') AS src_within, count(*) FILTER (WHERE reason='src_cross') AS src_cross,
 count(*) FILTER (WHERE reason='crop_within') AS crop_within, count(*) FILTER (WHERE reason='crop_cross') AS crop_cross, count(*) FILTER (WHERE reason='') AS rows_kept FROM lab GROUP BY source_no""")
def dedupe_stats(t):
    r = F.col("reason")
    return deduped(t).groupBy("source_no").agg(
        F.count(F.lit(1)).alias("rows_in"), *[F.count_if(r == x).alias(x) for x in ("src_within", "src_cross", "crop_within", "crop_cross")], F.count_if("keep").alias("rows_kept"))


@query("keep_first", f"WITH {DOCS}, a AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY doc_id) AS r1 FROM docs), b AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY doc_id) AS r2 FROM a WHERE r1=1) SELECT doc_id, source, lang, m, c FROM b WHERE r2=1")
def keep_first(t):
    """Byte-identical files first, then identical pixels: the first of each stays."""
    d = t.docs().select("doc_id", "source", "lang", "m", "c")
    return U.keep_first(U.keep_first(d, "m", ["doc_id"]), "c", ["doc_id"])


@query("content_md5", """SELECT doc_id, md5(text) AS bytes_md5, md5(concat_ws('|', CAST(n_chars AS VARCHAR), lang, text)) AS shaped_md5 FROM documents""")
def content_md5(t):
    return t.documents.select("doc_id", F.md5("text").alias("bytes_md5"), F.md5(F.concat_ws("|", F.col("n_chars").cast("string"), "lang", "text")).alias("shaped_md5"))


# A short fingerprint on which unlike documents collide: script, length class and ending.
FP = "md5(concat_ws('|', lang, CAST(n_chars//50 AS VARCHAR), right(text, 1)))"


def finger(t):
    fp = F.md5(F.concat_ws("|", "lang", F.floor(F.col("n_chars") / 50).cast("string"), F.right("text", F.lit(1))))
    return t.documents.select("doc_id", "source", fp.alias("h"))


@query("hash_cross_source", f"""WITH h AS (SELECT {FP} AS h, string_agg(DISTINCT source, '+' ORDER BY source) AS sources, count(DISTINCT source) AS n FROM documents GROUP BY 1) SELECT sources, count(*) AS buckets FROM h WHERE n > 1 GROUP BY sources""")
def hash_cross_source(t):
    return U.hash_cross_source(finger(t), "h", "source")


@query("hash_within", f"""WITH h AS (SELECT source, doc_id, {FP} AS h FROM documents), f AS (SELECT *, first_value(doc_id) OVER (PARTITION BY source, h ORDER BY doc_id) AS o FROM h) SELECT source, count(*) AS rows FROM f WHERE o <> doc_id GROUP BY source""")
def hash_within(t):
    return U.hash_within(finger(t), "h", "source", "doc_id", "doc_id")


@query("hash_vs_ref", f"""WITH r AS (SELECT DISTINCT {FP} AS h FROM documents WHERE source='src0') SELECT source, count(*) AS n FROM documents WHERE source <> 'src0' AND {FP} IN (SELECT h FROM r) GROUP BY source""")
def hash_vs_ref(t):
    f = finger(t)
    ref = f.where("source = 'src0'").select("h").distinct()
    return f.where("source <> 'src0'").join(ref, "h", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("diff_hash", f"""WITH {EMB}, b AS (SELECT vec_id, list_transform(range(1,64), lambda i: CASE WHEN e[i+1] > e[i] THEN '1' ELSE '0' END) AS bits FROM emb) SELECT vec_id, list_aggregate(bits, 'string_agg', '') AS bits FROM b""")
def diff_hash(t):
    e = t.emb()
    bits = F.zip_with(F.slice("e", 1, 63), F.slice("e", 2, 63), lambda a, b: F.when(b > a, "1").otherwise("0"))
    return e.select("vec_id", F.array_join(bits, "").alias("bits"))
