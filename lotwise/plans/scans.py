"""Scans, annotation texts, manifests, inventories and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions import core as fn
from lotwise.functions.scale import dense_index
from lotwise.operators import labels as L
from lotwise.plans.registry import query
from lotwise.plans.sqltext import DOCS, LOTS, r6
from lotwise.sources import scans as S


@query("scan_paths", r"""WITH p AS (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS parts FROM pages)
 SELECT page_id, parts[-1] AS leaf, CASE WHEN len(parts) >= 2 THEN parts[-2] END AS source_class, CASE WHEN len(parts) >= 3 THEN parts[-3] END AS split_hint FROM p""")
def scan_paths(t):
    path = F.regexp_replace("url", r"^[a-z]+://", "")
    return t.pages.select("page_id", *[c.alias(n) for n, c in S.path_parts(path).items()])


KEYWORDS = [("health", "healthy"), ("rust", "rust"), ("the", "miner"), ("tion", "phoma"), ("er", "cercospora")]


@query("label_from_path", """WITH x AS (SELECT page_id, CASE WHEN contains(lower(url),'health') THEN 'healthy' WHEN contains(lower(url),'rust') THEN 'rust' WHEN contains(lower(url),'the') THEN 'miner'
 WHEN contains(lower(url),'tion') THEN 'phoma' WHEN contains(lower(url),'er') THEN 'cercospora' END AS label FROM pages) SELECT * FROM x WHERE label IS NOT NULL""")
def label_from_path(t):
    return t.pages.select("page_id", L.label_from_keywords(F.col("url"), KEYWORDS).alias("label")).where(F.col("label").isNotNull())


@query("min_size_filter", "SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents WHERE n_chars >= 1000 GROUP BY source")
def min_size_filter(t):
    return t.documents.where("n_chars >= 1000").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("bytes"))


@query("parse_boxes", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_discount AS a, l_tax AS b, l_quantity AS c, CAST(l_linenumber AS DOUBLE) AS d FROM lineitem)
 SELECT l_orderkey AS photo, l_partkey AS part, CAST(l_linenumber AS INTEGER) AS class_no, CASE WHEN l_returnflag='N' THEN a-c/2 ELSE least(a,c,d) END AS x0, CASE WHEN l_returnflag='N' THEN b-d/2 ELSE least(b,d,a) END AS y0,
 CASE WHEN l_returnflag='N' THEN a+c/2 ELSE greatest(a,c,d) END AS x1, CASE WHEN l_returnflag='N' THEN b+d/2 ELSE greatest(b,d,a) END AS y1 FROM r WHERE l_returnflag IN ('N','A')""")
def parse_boxes(t):
    """Label lines written from the items (centre boxes, polygons, and short lines that must be skipped), parsed back."""
    a, b, c, d = "l_discount", "l_tax", "l_quantity", F.col("l_linenumber").cast("double")
    head = F.col("l_linenumber").cast("string")
    line = (F.when(F.col("l_returnflag") == "N", F.concat_ws(" ", head, a, b, c, d))
            .when(F.col("l_returnflag") == "A", F.concat_ws(" ", head, a, b, c, d, d, a)).otherwise(F.concat_ws(" ", head, a)))
    x = t.lineitem.select(F.col("l_orderkey").alias("photo"), F.col("l_partkey").alias("part"), line.alias("line"))
    return S.parse_box_lines(x, "line").drop("line")


@query("parse_kv_lines", """WITH k AS (SELECT event_id, CAST(json_extract_string(props,'$.k') AS INTEGER) AS k FROM events)
 SELECT 'f'||event_id AS stem, 'U' AS face FROM k WHERE k%2=1 AND k>=5 UNION ALL SELECT 'f'||event_id, 'D' FROM k WHERE k>50 AND k>=5""")
def parse_kv_lines(t):
    k = F.get_json_object("props", "$.k").cast("int")
    line = F.when(k >= 5, F.format_string("f%d.jpg: U-%d, D-%d", F.col("event_id"), k % 2, (k > 50).cast("int"))).otherwise("no colon here")
    return S.parse_face_lines(t.events.select(line.alias("line")), "line").select("stem", "face")


@query("labels_join", """SELECT d.doc_id, d.source, CASE WHEN quality=1 THEN 'healthy' ELSE 'rust' END AS class FROM documents d JOIN labels l USING (doc_id) WHERE toxic <> 1""")
def labels_join(t):
    lab = t.labels.where("toxic <> 1")
    return t.documents.select("doc_id", "source").join(lab, "doc_id").select("doc_id", "source", F.when(F.col("quality") == 1, "healthy").otherwise("rust").alias("class"))


@query("report_json", f"""WITH g AS (SELECT source, count(*) AS n, count(DISTINCT md5(text)) AS uniq, max(n_chars) FILTER (WHERE lang='es' AND n_chars > 20000) AS longest FROM documents GROUP BY source)
 SELECT source, '{{"source":"'||source||'","n":'||n||',"uniq":'||uniq||',"longest":'||coalesce(CAST(longest AS VARCHAR),'null')||',"bad":null}}' AS report FROM g""")
def report_json(t):
    g = t.documents.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(F.md5("text")).alias("uniq"), F.max(F.when((F.col("lang") == "es") & (F.col("n_chars") > 20000), F.col("n_chars"))).alias("longest"))
    g = g.withColumn("bad", F.lit(float("nan")))
    return S.json_report(g, ["source", "n", "uniq", "longest", "bad"]).select("source", "report")


@query("missing_partitions", """WITH e AS (SELECT 'src'||i AS source FROM range(24) r(i)), h AS (SELECT DISTINCT source FROM documents) SELECT coalesce(e.source,h.source) AS source, CASE WHEN h.source IS NULL THEN 'missing' WHEN e.source IS NULL THEN 'unexpected' ELSE 'present' END AS state
 FROM e FULL OUTER JOIN h ON e.source=h.source""")
def missing_partitions(t):
    expected = [f"src{i}" for i in range(24)]
    have = t.documents.select("source")
    miss = S.missing_folds(have, "source", expected).withColumn("state", F.lit("missing"))
    present = have.distinct().withColumn("state", F.when(F.col("source").isin(expected), "present").otherwise("unexpected"))
    return miss.unionByName(present)


_MANIFEST = """CASE WHEN page_id%4=0 THEN '{"trays":["'||url||'",{"file":"a/'||page_id||'.png","title":"real '||page_id||'","licence":" "}]}'
 WHEN page_id%4=1 THEN '[{"image":"./demo/'||page_id||'.jpg","id":'||page_id||',"source":"a synthetic set"},{"title":"no source"}]'
 WHEN page_id%4=2 THEN '{"photos":[{"png":"'||page_id||'.png","synthetic":true,"titleEn":"Shown"},"x.png"]}' ELSE 'not json '||page_id END"""


@query("alias_reader", """SELECT * FROM (
 SELECT page_id, 0 AS pos, url AS src, 'Tray 1' AS title, CAST(NULL AS VARCHAR) AS credit, contains(lower(url),'synthetic') AS synthetic FROM pages WHERE page_id%4=0 UNION ALL
 SELECT page_id, 1, '/app/demo/a/'||page_id||'.png', 'real '||page_id, NULL, FALSE FROM pages WHERE page_id%4=0 UNION ALL
 SELECT page_id, 0, '/app/demo/'||page_id||'.jpg', CAST(page_id AS VARCHAR), 'a synthetic set', TRUE FROM pages WHERE page_id%4=1 UNION ALL
 SELECT page_id, 0, '/app/demo/'||page_id||'.png', 'Shown', NULL, TRUE FROM pages WHERE page_id%4=2 UNION ALL
 SELECT page_id, 1, '/app/demo/x.png', 'Tray 2', NULL, FALSE FROM pages WHERE page_id%4=2)""")
def alias_reader(t):
    """Manifests in four shapes written from the pages, read by the tolerant reader."""
    m = t.pages.select("page_id", F.expr(_MANIFEST).alias("manifest"))
    return S.parse_manifest(m, "manifest", "/app/").select("page_id", "pos", "src", "title", "credit", "synthetic")


@query("dense_reindex", f"""WITH {LOTS}, used AS (SELECT DISTINCT lot, part FROM lots WHERE code <> 2), d AS (SELECT part, dense_rank() OVER (ORDER BY part) - 1 AS idx FROM (SELECT DISTINCT part FROM used))
 SELECT lot, part, idx FROM used JOIN d USING (part)""")
def dense_reindex(t):
    """Items used by any lot get dense new ids in natural order; the lots carry the new ids."""
    used = t.lots().where("code <> 2").select("lot", "part").distinct()
    return used.join(dense_index(used, "part"), "part").select("lot", "part", "idx")


@query("report_rows", """WITH c AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE lang='en') AS en, count(*) FILTER (WHERE lang='fr') AS fr FROM documents GROUP BY source)
 SELECT source, '| '||source||' | '||n||' | '||en||' | '||fr||' | '||printf('%.1f', 100.0e0*en/n)||'% |' AS line FROM c""")
def report_rows(t):
    c = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") == "fr").alias("fr"))
    return c.select("source", S.markdown_row(F.col("source"), F.col("n").cast("string"), F.col("en").cast("string"), F.col("fr").cast("string"),
                                             F.format_string("%.1f%%", 100.0 * F.col("en") / F.col("n"))).alias("line"))


@query("registry_join", """SELECT s_suppkey AS source, n_name AS licence, r_name AS country FROM supplier LEFT JOIN nation ON s_nationkey=n_nationkey LEFT JOIN region ON n_regionkey=r_regionkey""")
def registry_join(t):
    reg = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return t.supplier.join(reg, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("s_suppkey").alias("source"), F.col("n_name").alias("licence"), F.col("r_name").alias("country"))


@query("class_report", """SELECT lang, source, count(*) AS n, rank() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS place FROM documents GROUP BY lang, source ORDER BY lang, n DESC, source""")
def class_report(t):
    from pyspark.sql import Window

    c = t.documents.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    place = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("n"), "source")).cast("long")
    return c.withColumn("place", place).orderBy("lang", F.desc("n"), "source")


@query("union_sources", """SELECT * FROM (SELECT 'doc' AS origin, source, lang, NULL AS host, count(*) AS n FROM documents GROUP BY source, lang UNION ALL
 SELECT 'page', NULL, NULL, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), count(*) FROM pages GROUP BY 4)""")
def union_sources(t):
    a = t.documents.groupBy(F.lit("doc").alias("origin"), "source", "lang").agg(F.count(F.lit(1)).alias("n"))
    b = t.pages.groupBy(F.lit("page").alias("origin"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b, allowMissingColumns=True)


@query("set_difference", "SELECT o_custkey AS cust FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_difference(t):
    o = t.orders
    return o.select(F.col("o_custkey").alias("cust")).distinct().join(o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("cust")).distinct(), "cust", "left_anti")
