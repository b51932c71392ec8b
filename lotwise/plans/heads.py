"""Prototype heads, batch scoring and ML baselines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lotwise.functions import core as fn
from lotwise.operators import localhead as H
from lotwise.operators import scoring as B
from lotwise.plans.metrics import rnd
from lotwise.plans.registry import query
from lotwise.plans.robust import FEATURES, hand
from lotwise.plans.sqltext import EMB, r6
from lotwise.session import cut_lineage

UNITS = """ue AS (SELECT vec_id, source, p, (y<>0)::INT AS d, list_transform(e, lambda x: x/greatest(sqrt(list_sum(list_transform(e, lambda y: y*y))),1e-9)) AS u FROM emb)"""
HEADS = """sm AS (SELECT source, d, i, sum(u[i]) AS s FROM ue, range(1,65) r(i) GROUP BY source, d, i), sv AS (SELECT source, d, list(s ORDER BY i) AS s FROM sm GROUP BY source, d),
 hd AS (SELECT g.source, g.s AS sg, b.s AS sd, list_transform(g.s, lambda x: x/greatest(sqrt(list_dot_product(g.s,g.s)),1e-12)) AS mg, list_transform(b.s, lambda x: x/greatest(sqrt(list_dot_product(b.s,b.s)),1e-12)) AS md FROM sv g JOIN sv b ON g.source=b.source AND g.d=0 AND b.d=1),
 rs AS (SELECT ue.source, ue.d, ue.u, mg, md, list_transform(list_zip(CASE WHEN ue.d=1 THEN sd ELSE sg END, ue.u), lambda q: q[1]-q[2]) AS rest FROM ue JOIN hd USING (source)),
 lo AS (SELECT source, d, CASE WHEN d=1 THEN list_dot_product(u,rest)/greatest(sqrt(list_dot_product(rest,rest)),1e-12)-list_dot_product(u,mg) ELSE list_dot_product(u,md)-list_dot_product(u,rest)/greatest(sqrt(list_dot_product(rest,rest)),1e-12) END AS s FROM rs),
 hm AS (SELECT source, count(*) FILTER (WHERE d=0) AS n_good, count(*) FILTER (WHERE d=1) AS n_defect, count(*) FILTER (WHERE (s>=0) <> (d=1)) AS loo_errors, greatest(coalesce(max(abs(s)) FILTER (WHERE (s>=0) <> (d=1)),0), median(abs(s))) AS m_hi, count(*) AS n FROM lo GROUP BY source)"""


def unit_items(t):
    return t.emb().select("vec_id", "source", fn.unit("e").alias("u"), (F.col("y") != 0).cast("int").alias("d"), "logits")


@query("proto_fit", f"""WITH {EMB}, {UNITS}, {HEADS} SELECT source, n_good, n_defect, loo_errors, {r6('m_hi')} AS m_hi, CASE WHEN n_good < 10 OR n_defect < 10 THEN 'too_few' WHEN loo_errors/CAST(n AS DOUBLE) > 0.1e0 THEN 'loo_errors' ELSE '' END AS refused,
 {r6('list_dot_product(mg,md)')} AS mu_cos FROM hm JOIN hd USING (source)""")
def proto_fit(t):
    h = H.proto_fit(unit_items(t), ["source"], "u", "d")
    return h.select("source", "n_good", "n_defect", "loo_errors", fn.r6("m_hi").alias("m_hi"), "refused", fn.r6(fn.dot("mu_good", "mu_defect")).alias("mu_cos"))


@query("proto_answer", f"""WITH {EMB}, {UNITS}, {HEADS}, a AS (SELECT ue.source, ue.vec_id, list_dot_product(u,md)-list_dot_product(u,mg) AS s, m_hi, (p[1] < 0.16e0)::INT AS base FROM ue JOIN hd USING (source) JOIN hm USING (source))
 SELECT source, CASE WHEN (s>=0)::INT=base THEN 'agree' WHEN abs(s)>=m_hi THEN 'high_margin' ELSE 'none' END AS how, CASE WHEN (s>=0)::INT=base OR abs(s)>=m_hi THEN (s>=0)::INT ELSE 2 END AS code, count(*) AS n, {r6('sum(s)')} AS score FROM a GROUP BY 1, 2, 3""")
def proto_answer(t):
    x = unit_items(t)
    heads = H.proto_fit(x, ["source"], "u", "d")
    a = H.proto_answer(x, heads, ["source"], "u", F.get(fn.softmax("logits"), 0) < 0.16)
    return a.groupBy("source", "how", "code").agg(F.count(F.lit(1)).alias("n"), fn.r6(F.sum("score")).alias("score"))


@query("logit_head")
def logit_head(t):
    """Balanced logistic head per source with its leave-one-out errors and margin; held against numpy in the tests."""
    h = H.logit_fit(unit_items(t), ["source"], "vec_id", "u", "d")
    return h.select("source", "n_good", "n_defect", "loo_errors", fn.r6("m_hi").alias("m_hi"), "refused", fn.r6("bias").alias("bias"))


@query("logit_margins")
def logit_margins(t):
    """Leave-one-out margin of every item under its source's logistic head."""
    h = H.logit_fit(unit_items(t), ["source"], "vec_id", "u", "d")
    pair = F.explode(F.arrays_zip("items", "margins"))
    return h.select("source", pair.alias("m")).select("source", F.col("m.items").alias("vec_id"), fn.r6("m.margins").alias("margin"))


@query("ml_baselines")
def ml_baselines(t):
    """Depth-2 tree and standardised logistic regression, trained on the other sources and tested on the held-out one; rows only."""
    h = cut_lineage(hand(t).select("vec_id", "source", (F.col("y") != 0).cast("double").alias("label"), *FEATURES))  # read by every fit
    out = None
    for held in range(5):  # one fit per held-out source
        for kind in ("tree", "logistic"):
            m = H.ml_baseline(h.where(F.col("source") != held), FEATURES, "label", kind)
            r = m.transform(h.where(F.col("source") == held)).groupBy(F.lit(held).alias("held_out"), F.lit(kind).alias("model")).agg(
                F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("label") == 1, F.col("prediction"))), 3).alias("sensitivity"), F.round(F.avg(F.when(F.col("label") == 0, F.col("prediction"))), 3).alias("fpr"))
            out = r if out is None else out.unionByName(r)
    return out


@query("batch_score", f"""WITH {EMB}, z AS (SELECT vec_id, list_transform(range(6), lambda k: list_sum(list_transform(range(64), lambda j: e[j+1]*(((k*7+j*13)%11)-5)/2.0e0))) AS z FROM emb), x AS (SELECT vec_id, list_transform(z, lambda v: exp(v-list_max(z))) AS ex FROM z)
 SELECT vec_id, {', '.join(f'{r6(f"ex[{i + 1}]/list_sum(ex)")} AS p{i}' for i in range(6))} FROM x""")
def batch_score(t):
    """A linear softmax head through the Arrow batch scorer."""
    k, j = np.meshgrid(np.arange(6), np.arange(64), indexing="ij")
    w = (((k * 7 + j * 13) % 11) - 5) / 2.0
    s = B.score_batches(t.emb(), "e", ["vec_id"], B.linear_softmax(w))
    return s.select("vec_id", *[fn.r6(F.get("probs", i)).alias(f"p{i}") for i in range(6)])


@query("explode_udtf", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)),1)-1 AS line_no FROM documents)
 SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(len(list_filter(string_split(line, ' '), lambda w: w <> '')) AS INTEGER) AS n_words, CAST(length(line) AS INTEGER) AS n_chars FROM l WHERE NOT regexp_full_match(line, '\s*')""")
def explode_udtf(t):
    """One input row to many through a table function with a lateral join."""
    t.spark.udtf.register("text_lines", B.TextLines)
    t.documents.select("doc_id", "text").createOrReplaceTempView("_texts")
    return t.spark.sql("SELECT doc_id, l.line_no, l.n_words, l.n_chars FROM _texts, LATERAL text_lines(text) l")
