"""Similarity joins, neighbours and matching by geometry or sequence."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise import constants as C
from lotwise.functions import core as fn
from lotwise.operators import calls as K
from lotwise.operators import matching as J
from lotwise.operators import metrics as M
from lotwise.operators import vectors as X
from lotwise.plans.metrics import rnd
from lotwise.plans.registry import query
from lotwise.plans.sqltext import EMB, ITEMS, LOTS, SCORES, r6
from lotwise.session import cut_lineage

NEAR = 0.35  # the highest cosine in the test vectors is about .51, so the shipped .998 would find nothing
UNIT = """un AS (SELECT *, list_transform(e, lambda x: x/greatest(sqrt(list_sum(list_transform(e, lambda y: y*y))),1e-9)) AS u FROM emb)"""


@query("near_dup_pairs", f"""WITH {EMB}, {UNIT}, v AS (SELECT e, any_value(u) AS u, min(vec_id) AS id, count(*) AS copies, min(photo) AS g0, max(photo) AS g1 FROM un GROUP BY e),
 f AS (SELECT a.id, count(*) AS partners, min(b.id) AS first_partner, max(list_dot_product(a.u,b.u)) AS best FROM v a JOIN v b ON a.id <> b.id WHERE list_dot_product(a.u,b.u) >= 0.35e0 AND NOT (a.g0=a.g1 AND b.g0=b.g1 AND a.g0=b.g0) GROUP BY a.id)
 SELECT v.id, copies, g0 <> g1 AS spans_groups, coalesce(partners,0) AS partners, first_partner, {r6('best')} AS best_cos FROM v LEFT JOIN f USING (id) WHERE partners IS NOT NULL OR g0 <> g1""")
def near_dup_pairs(t):
    """Near-duplicate partners of every vector, one line per vector."""
    return rnd(X.near_dup_partners(t.emb(), "vec_id", "e", "photo", NEAR), ["id", "copies", "spans_groups", "partners", "first_partner"], "best_cos")


@query("near_dup_keep", f"""WITH RECURSIVE {EMB}, {UNIT}, o AS (SELECT vec_id, photo, u, row_number() OVER (ORDER BY vec_id) AS i FROM un),
 nb AS (SELECT b.i, list(a.i) AS prev FROM o a JOIN o b ON a.i < b.i AND a.photo <> b.photo AND list_dot_product(a.u,b.u) >= 0.35e0 GROUP BY b.i), n2 AS (SELECT o.i, coalesce(prev, []) AS prev FROM o LEFT JOIN nb USING (i)),
 st AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT k+1, CASE WHEN list_has_any(kept, n2.prev) THEN kept ELSE list_append(kept, k+1) END FROM st JOIN n2 ON n2.i = k+1)
 SELECT vec_id, list_contains((SELECT kept FROM st ORDER BY k DESC LIMIT 1), i) AS keep FROM o""")
def near_dup_keep(t):
    return X.near_dup_keep(t.emb(), "vec_id", "e", "photo", NEAR).select("vec_id", "keep")


LETTERS = "abcdefghijklmnopqrstuvwxyz"
# counts of the letters of a text, less their mean: near copies are at a cosine of .998 or more
LETTER_SQL = f"""lc AS MATERIALIZED (SELECT doc_id, source, list_transform(string_split('{LETTERS}', ''), lambda c: CAST(length(text)-length(replace(text, c, '')) AS DOUBLE)) AS v FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)),
 lm AS (SELECT doc_id, source, list_transform(v, lambda x: x-list_sum(v)/26) AS c FROM lc), un AS MATERIALIZED (SELECT doc_id, source, c, list_transform(c, lambda x: CASE WHEN list_dot_product(c,c) > 0 THEN x/sqrt(list_dot_product(c,c)) ELSE 0e0 END) AS u FROM lm)"""


def letter_vectors(t):
    """Documents with their centred letter counts."""
    text = F.coalesce("text", F.lit(""))
    counts = F.array(*[(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double") for c in LETTERS])
    return X.centred(t.documents.select("doc_id", "source", counts.alias("v")), "v", "u", unit=False).drop("v")


@query("near_dup_texts", f"""WITH {LETTER_SQL}, v AS (SELECT c, any_value(u) AS u, min(doc_id) AS id, count(*) AS copies, min(source) AS g0, max(source) AS g1 FROM un GROUP BY c),
 f AS (SELECT a.id, count(*) AS partners, min(b.id) AS first_partner, max(list_dot_product(a.u,b.u)) AS best FROM v a JOIN v b ON a.id <> b.id WHERE list_dot_product(a.u,b.u) >= 0.998e0 AND NOT (a.g0=a.g1 AND b.g0=b.g1 AND a.g0=b.g0) GROUP BY a.id)
 SELECT v.id, copies, g0 <> g1 AS spans_groups, coalesce(partners,0) AS partners, first_partner, {r6('best')} AS best_cos FROM v LEFT JOIN f USING (id) WHERE partners IS NOT NULL OR g0 <> g1""")
def near_dup_texts(t):
    """Near-duplicate partners of other sources at the shipped threshold, one line per distinct vector that has any."""
    v = letter_vectors(t)
    return rnd(X.near_dup_partners(v, "doc_id", "u", "source", C.NEAR_DUP_COS), ["id", "copies", "spans_groups", "partners", "first_partner"], "best_cos")


@query("near_dup_keep_texts", f"""WITH RECURSIVE {LETTER_SQL}, o AS MATERIALIZED (SELECT doc_id, source, u, row_number() OVER (ORDER BY doc_id) AS i FROM un WHERE list_dot_product(c,c) > 0),
 nb AS (SELECT b.i, list(a.i) AS prev FROM o a JOIN o b ON a.i < b.i AND a.source <> b.source AND list_dot_product(a.u,b.u) >= 0.998e0 GROUP BY b.i), n2 AS MATERIALIZED (SELECT o.i, coalesce(prev, []) AS prev FROM o LEFT JOIN nb USING (i)),
 st AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT k+1, CASE WHEN list_has_any(kept, n2.prev) THEN kept ELSE list_append(kept, k+1) END FROM st JOIN n2 ON n2.i = k+1)
 SELECT un.doc_id, o.i IS NULL OR list_contains((SELECT kept FROM st ORDER BY k DESC LIMIT 1), o.i) AS keep FROM un LEFT JOIN o USING (doc_id)""")
def near_dup_keep_texts(t):
    """Greedy removal over the letter counts of all documents at the shipped threshold."""
    vectors = cut_lineage(letter_vectors(t))  # written once: a filter on them would count the letters anew for every component
    return X.near_dup_keep(vectors, "doc_id", "u", "source", C.NEAR_DUP_COS).select("doc_id", "keep")


BITS = """bt AS (SELECT vec_id, source, list_aggregate(list_transform(e, lambda x: CASE WHEN x > 0.12e0 THEN '1' ELSE '0' END), 'string_agg', '') AS bits FROM emb)"""


@query("hamming_lsh", f"""WITH {EMB}, {BITS}, h AS (SELECT bits, min(vec_id) AS id, count(*) AS copies, [CAST(('0b'||substr(bits,1,16)) AS BIGINT), CAST(('0b'||substr(bits,17,16)) AS BIGINT), CAST(('0b'||substr(bits,33,16)) AS BIGINT), CAST(('0b'||substr(bits,49,16)) AS BIGINT)] AS w FROM bt GROUP BY bits),
 p AS (SELECT a.id, b.id AS o, CAST(bit_count(xor(a.w[1],b.w[1]))+bit_count(xor(a.w[2],b.w[2]))+bit_count(xor(a.w[3],b.w[3]))+bit_count(xor(a.w[4],b.w[4])) AS INTEGER) AS distance FROM h a JOIN h b ON a.id <> b.id
   AND (a.w[1]=b.w[1] OR a.w[2]=b.w[2] OR a.w[3]=b.w[3] OR a.w[4]=b.w[4])), f AS (SELECT id, count(*) AS partners, min(o) AS first_partner, min(distance) AS distance FROM p WHERE distance <= 8 GROUP BY id)
 SELECT h.id, copies, coalesce(partners,0) AS partners, first_partner, distance FROM h LEFT JOIN f USING (id) WHERE partners IS NOT NULL OR copies > 1""")
def hamming_lsh(t):
    """Perceptual-hash partners over four bands of sixteen bits, one line per distinct hash."""
    bits = F.array_join(F.transform("e", lambda x: F.when(x > 0.12, "1").otherwise("0")), "")
    return X.hamming_partners(t.emb().select("vec_id", bits.alias("bits")), "vec_id", "bits")


@query("cross_source_nn", f"""WITH {EMB}, {UNIT}, p AS (SELECT a.vec_id, a.source, b.vec_id AS nn, b.source AS nn_source, list_dot_product(a.u,b.u) AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.u,b.u) DESC, b.vec_id) AS rn FROM un a JOIN un b ON a.source <> b.source)
 SELECT source, nn_source, count(*) AS n, {r6('max(sim)')} AS max_sim, {r6('avg((sim >= 0.3e0)::INT)')} AS share_close FROM p WHERE rn=1 GROUP BY source, nn_source""")
def cross_source_nn(t):
    """Nearest neighbour of every item in a different source, and how many are close, per pair of sources."""
    e = t.emb().select(F.col("vec_id").alias("id"), F.col("e").alias("vec"), "source")
    nn = X.nearest(e, e, 1, tag="source")
    src = e.select("id", "source")
    x = nn.join(src.withColumnRenamed("id", "qid"), "qid").join(src.select(F.col("id").alias("bid"), F.col("source").alias("nn_source")), "bid")
    return x.groupBy("source", "nn_source").agg(F.count(F.lit(1)).alias("n"), fn.r6(F.max("sim")).alias("max_sim"), fn.r6(M.share(F.col("sim") >= 0.3)).alias("share_close"))


@query("knn_bank", f"""WITH {EMB}, {UNIT}, d AS (SELECT q.vec_id, 1-list_dot_product(q.u,b.u) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.u,b.u) DESC, b.vec_id) AS rn FROM un q JOIN un b ON b.y = 0 AND q.y <> 0)
 SELECT vec_id, {r6('avg(d)')} AS distance FROM d WHERE rn <= 5 GROUP BY vec_id""")
def knn_bank(t):
    e = t.emb().select(F.col("vec_id").alias("id"), F.col("e").alias("vec"), "y")
    d = X.knn_distance(e.where("y <> 0").drop("y"), e.where("y = 0").drop("y"), 5)
    return d.select(F.col("qid").alias("vec_id"), fn.r6("distance").alias("distance"))


KNN_LOO = """kl AS (SELECT a.photo, a.vec_id, avg(d) AS distance FROM (SELECT a.photo, a.vec_id, 1-list_dot_product(a.u,b.u) AS d, row_number() OVER (PARTITION BY a.photo, a.vec_id ORDER BY list_dot_product(a.u,b.u) DESC, b.vec_id) AS rn
 FROM un a JOIN un b ON a.photo=b.photo AND a.vec_id<>b.vec_id) a WHERE rn <= 5 GROUP BY a.photo, a.vec_id)"""


def loo_distance(t):
    e = t.emb().select("photo", F.col("vec_id").alias("id"), F.col("e").alias("vec"))
    return X.knn_distance(e, e, 5, by=["photo"]).select("photo", F.col("qid").alias("vec_id"), "distance")


@query("knn_loo", f"WITH {EMB}, {UNIT}, {KNN_LOO} SELECT photo, vec_id, {r6('distance')} AS distance FROM kl")
def knn_loo(t):
    return rnd(loo_distance(t), ["photo", "vec_id"], "distance")


@query("cosine", f"""WITH {EMB}, {UNIT}, c AS (SELECT label, list_transform(range(1,65), lambda i: list_sum(list_transform(es, lambda v: v[i]))/len(es)) AS m FROM (SELECT label, list(e) AS es FROM emb GROUP BY label))
 SELECT vec_id, {r6('list_dot_product(e,m)/(greatest(sqrt(list_dot_product(e,e)),1e-9)*greatest(sqrt(list_dot_product(m,m)),1e-9))')} AS cos, {r6('sqrt(list_dot_product(e,e))')} AS norm FROM emb JOIN c USING (label)""")
def cosine(t):
    """Every vector against the mean vector of its label."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    e = t.emb().select("vec_id", "label", "e")
    mean = e.groupBy("label").agg(vector_to_array(Summarizer.mean(array_to_vector("e"))).alias("m"))
    return e.join(mean, "label").select("vec_id", fn.r6(fn.cosine("e", "m")).alias("cos"), fn.r6(fn.l2norm("e")).alias("norm"))


# ---------------------------------------------------------------- matching

ANN = """ann AS (SELECT photo, item AS ann, x0 + (part%5) - 2 AS x0, y0 + (part%3) - 1 AS y0, x1 + (part%7) - 3 AS x1, y1 + (part%4) - 2 AS y1 FROM items WHERE flag <> 'N')"""


def annotations(t):
    p = F.col("part")
    return t.items().where("flag <> 'N'").select(
        "photo", F.col("item").alias("ann"), (F.col("x0") + p % 5 - 2).alias("x0"), (F.col("y0") + p % 3 - 1).alias("y0"), (F.col("x1") + p % 7 - 3).alias("x1"), (F.col("y1") + p % 4 - 2).alias("y1"))


IOU = """iw AS (SELECT f.photo, f.item, ann.ann, greatest(0.0e0, least(f.x1,ann.x1)-greatest(f.x0,ann.x0))*greatest(0.0e0, least(f.y1,ann.y1)-greatest(f.y0,ann.y0)) AS inter, (f.x1-f.x0)*(f.y1-f.y0) AS fa, (ann.x1-ann.x0)*(ann.y1-ann.y0) AS aa FROM items f JOIN ann USING (photo)
 WHERE f.x0 <= ann.x1 AND ann.x0 <= f.x1 AND f.y0 <= ann.y1 AND ann.y0 <= f.y1), iou AS (SELECT photo, item, ann, inter/nullif(fa+aa-inter,0) AS iou FROM iw WHERE inter/nullif(fa+aa-inter,0) >= 0.5e0)"""


def pairs(t):
    return J.iou_pairs(t.items(), annotations(t), "photo", "item", "ann")


@query("iou_pairs", f"WITH {ITEMS}, {ANN}, {IOU} SELECT photo, item, count(*) AS partners, arg_min(ann, (-round(iou,9), ann)) AS best, {r6('max(iou)')} AS iou FROM iou GROUP BY photo, item")
def iou_pairs(t):
    p = pairs(t).groupBy("photo", "item").agg(F.count(F.lit(1)).alias("partners"), F.min_by("ann", F.struct(-F.round("iou", 9), F.col("ann"))).alias("best"), F.max("iou").alias("iou"))
    return rnd(p, ["photo", "item", "partners", "best"], "iou")


@query("iou_greedy", f"""WITH RECURSIVE {ITEMS}, {ANN}, {IOU}, c AS (SELECT photo, item, list(ann ORDER BY round(iou,9) DESC, ann) AS cand FROM iou GROUP BY photo, item), k AS (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY item) AS k FROM c),
 st AS (SELECT DISTINCT photo, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS item, CAST(NULL AS VARCHAR) AS ann FROM k UNION ALL
  SELECT photo, k, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, item, pick FROM (SELECT st.photo, k.k, st.used, k.item, list_filter(k.cand, lambda a: NOT list_contains(st.used, a))[1] AS pick FROM st JOIN k ON k.photo=st.photo AND k.k=st.k+1))
 SELECT st.photo, st.item, st.ann, {r6('round(iou,9)')} AS iou FROM st JOIN iou ON iou.photo=st.photo AND iou.item=st.item AND iou.ann=st.ann""")
def iou_greedy(t):
    """Found boxes, in found order, take the best annotation that is still free."""
    p = pairs(t).withColumn("iou", F.round("iou", 9))
    return rnd(J.greedy_match(p, "photo", "item", "ann"), ["photo", "item", "ann"], "iou")


@query("nearest_point", f"""WITH {ITEMS}, f AS (SELECT photo, item, (x0+x1)/2 AS cx, (y0+y1)/2 AS cy FROM items WHERE flag='N'), p AS (SELECT photo, item AS point, (x0+x1)/2 AS px, (y0+y1)/2 AS py FROM items WHERE flag='A'),
 d AS (SELECT f.photo, f.item, p.point, power(cx-px,2)+power(cy-py,2) AS d2 FROM f JOIN p USING (photo)), b AS (SELECT photo, item, point, d2, row_number() OVER (PARTITION BY photo, item ORDER BY d2, point) AS rn FROM d WHERE sqrt(d2) < 30)
 SELECT f.photo, f.item, b.point, {r6('sqrt(b.d2)')} AS distance FROM f LEFT JOIN b ON f.photo=b.photo AND f.item=b.item AND b.rn=1""")
def nearest_point(t):
    c = t.items().select("photo", "item", "flag", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    n = J.nearest_point(c.where("flag = 'N'"), c.where("flag = 'A'").withColumnRenamed("item", "point"), "photo", "item", "point", 30.0)
    return rnd(n, ["photo", "item", "point"], "distance")


@query("points_in_box", f"""WITH {ITEMS}, p AS (SELECT photo, (x0+x1)/2 AS px, (y0+y1)/2 AS py FROM items WHERE flag='A'), n AS (SELECT f.photo, f.item, count(px) AS centres FROM (SELECT * FROM items WHERE flag='N') f LEFT JOIN p ON p.photo=f.photo AND px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 GROUP BY f.photo, f.item)
 SELECT photo, count(*) AS items, CAST(sum(centres) AS BIGINT) AS centres, count(*) FILTER (WHERE centres >= 2) AS merged FROM n GROUP BY photo""")
def points_in_box(t):
    i = t.items()
    pts = i.where("flag = 'A'").select("photo", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    n = J.points_in_box(i.where("flag = 'N'"), pts, "photo", "item")
    return n.groupBy("photo").agg(F.count(F.lit(1)).alias("items"), F.sum("centres").alias("centres"), F.count_if(F.col("centres") >= 2).alias("merged"))


@query("sequence_gap_anti", """WITH c AS (SELECT o_custkey % 40 AS grp, o_orderkey AS no FROM orders WHERE o_orderpriority='1-URGENT'), x AS (SELECT o_custkey % 40 AS grp, o_orderkey AS no FROM orders WHERE o_orderpriority<>'1-URGENT')
 SELECT grp, count(*) AS kept, max(no) AS last_no FROM x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.grp=x.grp AND abs(c.no-x.no) <= 20) GROUP BY grp""")
def sequence_gap_anti(t):
    o = t.orders.select((F.col("o_custkey") % 40).alias("grp"), F.col("o_orderkey").alias("no"), "o_orderpriority")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    kept = J.sequence_gap_anti(o.where(~urgent), o.where(urgent), ["grp"], "no", 20)
    return kept.groupBy("grp").agg(F.count(F.lit(1)).alias("kept"), F.max("no").alias("last_no"))


@query("oof_select", f"""WITH {SCORES}, f AS (SELECT event_id, 1 AS fold, p_good AS p FROM scores UNION ALL SELECT event_id, 2, 1/(1+exp((value-40)/20)) FROM scores), s AS (SELECT event_id, CASE WHEN p_good >= 0.5e0 THEN 2 ELSE 1 END AS test_fold FROM scores)
 SELECT event_id, test_fold, {r6('p')} AS p FROM s JOIN f USING (event_id) WHERE fold=test_fold""")
def oof_select(t):
    """Each item takes the prediction of the fold that did not see it."""
    s = t.scores()
    preds = s.select("event_id", F.explode(F.array(F.struct(F.lit(1).alias("fold"), F.col("p_good").alias("p")), F.struct(F.lit(2).alias("fold"), (1 / (1 + F.exp((F.col("value") - 40) / 20))).alias("p")))).alias("f")).select("event_id", "f.*")
    items = s.select("event_id", F.when(F.col("p_good") >= 0.5, 2).otherwise(1).alias("fold"))
    return items.join(preds, ["event_id", "fold"]).select("event_id", F.col("fold").alias("test_fold"), fn.r6("p").alias("p"))


@query("prediction_parity", f"""WITH {EMB}, q AS (SELECT *, list_transform(p, lambda x: round(x,2)) AS p2 FROM emb), d AS (SELECT source, list_max(list_transform(list_zip(p,p2), lambda s: abs(s[1]-s[2]))) AS d, list_position(p,list_max(p))=list_position(p2,list_max(p2)) AS am,
 CASE WHEN p[1]>=0.3e0 THEN 0 WHEN 1-p[1]>=0.91e0 THEN 1 ELSE 2 END = CASE WHEN p2[1]>=0.3e0 THEN 0 WHEN 1-p2[1]>=0.91e0 THEN 1 ELSE 2 END AS ca, list_cosine_similarity(p,p2) AS cs FROM q)
 SELECT source, count(*) AS n, {r6('max(d)')} AS max_abs_diff, {r6('avg(am::INT)')} AS argmax_agreement, {r6('avg(ca::INT)')} AS call_agreement, {r6('min(cs)')} AS min_cosine, {r6('avg(cs)')} AS mean_cosine FROM d GROUP BY source""")
def prediction_parity(t):
    a = t.emb().select("vec_id", "source", fn.softmax("logits").alias("p"))
    b = a.select("vec_id", F.transform("p", lambda x: F.round(x, 2)).alias("p"))
    call = K.call_pair(F.get("p", 0), None, 0.3, 0.91)
    out = J.prediction_parity(a, b, "vec_id", "p", call, call, "source")
    return rnd(out, ["source", "n"], "max_abs_diff", "argmax_agreement", "call_agreement", "min_cosine", "mean_cosine")


@query("integrity_check", """WITH a AS (SELECT l_orderkey AS k, count(*) AS n, sum(l_quantity) AS v FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k, count(*) AS n, sum(10.0e0) AS v FROM orders GROUP BY 1)
 SELECT count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS both, count(*) FILTER (WHERE b.k IS NULL) AS only_left, count(*) FILTER (WHERE a.k IS NULL) AS only_right, count(*) FILTER (WHERE a.n > 1) AS dup_left, count(*) FILTER (WHERE b.n > 1) AS dup_right,
 max(abs(a.v-b.v)) AS max_abs_diff FROM a FULL OUTER JOIN b ON a.k=b.k""")
def integrity_check(t):
    a = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("v"))
    b = t.orders.select(F.col("o_orderkey").alias("k"), F.lit(10.0).alias("v"))
    return J.integrity_check(a, b, ["k"], "v")


@query("split_members", f"""WITH {LOTS}, tr AS (SELECT DISTINCT lot FROM lots WHERE flag='R' AND qty > 49 AND discount > 0.09e0), x AS (SELECT lot, photo, lot IN (SELECT lot FROM tr) AS held FROM lots) SELECT CASE WHEN held THEN 'test' ELSE 'train' END AS role, count(*) AS items, count(DISTINCT lot) AS lots FROM x GROUP BY 1""")
def split_members(t):
    lots = t.lots()
    held = lots.where("flag = 'R' and qty > 49 and discount > 0.09D").select("lot").distinct()
    one = lambda how, role: lots.select("lot").join(held, "lot", how).groupBy("lot").agg(F.count(F.lit(1)).alias("n")).groupBy(F.lit(role).alias("role")).agg(F.sum("n").alias("items"), F.count(F.lit(1)).alias("lots"))
    return one("left_semi", "test").unionByName(one("left_anti", "train"))
