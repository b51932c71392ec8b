"""Batch twins of the streams, and the streams themselves run to the end over the given events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lotwise.functions import core as fn
from lotwise.operators import verdict as V
from lotwise.plans.metrics import rnd
from lotwise.plans.registry import query
from lotwise.plans.sampling import HISTORY, new_start
from lotwise.plans.sqltext import r6, verdict
from lotwise.session import shared_folder
from lotwise.sources.tables import SCHEMAS
from lotwise.streaming import streams as S

EV = """ev AS (SELECT *, user_id % 7 AS source, CASE WHEN value >= 150 THEN 2 WHEN event_type='error' THEN 1 ELSE 0 END AS code FROM events)"""
KEEP = ["total", "defects", "unsure", "answered"]
COLS = f"total, defects, unsure, answered, {r6('p')} AS p, {r6('lo')} AS lo, {r6('hi')} AS hi, band, reason"


def shown(df, keys):
    return df.select(*keys, *KEEP, fn.r6("p").alias("p"), fn.r6("lo").alias("lo"), fn.r6("hi").alias("hi"), "band", "reason")


def stream(t, pattern="events"):
    """The given events table as a file stream (one file, so one batch here; many on a real landing folder)."""
    return t.spark.readStream.schema(SCHEMAS["events"]).option("pathGlobFilter", f"{pattern}*").parquet(t.folder)


TUMBLING = f"""WITH {EV}, d AS (SELECT *, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS start FROM ev), v AS ({verdict('d', 'start, source')}) SELECT start, source, {COLS} FROM v"""


@query("window_verdict", TUMBLING)
def window_verdict(t):
    return shown(S.window_verdict(t.events), ["start", "source"])


@query("window_verdict_sliding", f"""WITH {EV}, d AS (SELECT *, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') - to_hours(CAST(6*k AS BIGINT)) AS start FROM ev, range(4) r(k)), v AS ({verdict('d', 'start, source')}) SELECT start, source, {COLS} FROM v""")
def window_verdict_sliding(t):
    return shown(S.window_verdict(t.events, "1 day", "6 hours"), ["start", "source"])


SESSIONS = f"""WITH {EV}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS nw FROM ev), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g),
 b AS (SELECT user_id, sid, min(ts) AS start FROM s GROUP BY user_id, sid), v AS ({verdict('s', 'user_id, sid')}) SELECT v.user_id, b.start, {COLS} FROM v JOIN b USING (user_id, sid)"""


@query("session_lots", SESSIONS)
def session_lots(t):
    return shown(V.decide(S.session_counts(t.events)), ["user_id", "start"])


@query("stream_window_verdict", TUMBLING)
def stream_window_verdict(t):
    """The tumbling verdict as a stream with a watermark. A last event far ahead closes the open windows."""
    return shown(S.drain(S.window_verdict(closed(t), late="1 hour")).where("start < timestamp'2200-01-01'"), ["start", "source"])


def closed(t):
    """The event stream and, beside it, one marker row far in the future that moves the watermark past every real window."""
    base = f"{shared_folder(t.spark)}/marker-{uuid.uuid4().hex}"
    end = t.events.agg(F.max("event_id").alias("m")).select(
        (F.col("m") + 1).alias("event_id"), F.lit("2200-01-01").cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(0.0).alias("value"), F.lit('{"k": 0}').alias("props"))
    end.write.parquet(base)
    return stream(t).unionByName(t.spark.readStream.schema(SCHEMAS["events"]).parquet(base))


@query("stream_last_n", f"""WITH {HISTORY} SELECT "user" AS user_id, id, event_id, ts, value FROM hn WHERE r2 <= 5""")
def stream_last_n(t):
    """The five newest per user since the last wipe, as a stream."""
    return S.current_history(S.drain(S.last_n_stream(stream(t), wipe=new_start())))


def _reason(t, d, u):
    return f"CASE WHEN {t}-{u}=0 THEN 'too_many_unsure' WHEN {d}/CAST({t}-{u} AS DOUBLE) > 0.6e0 THEN 'implausible' WHEN {u}/CAST({t} AS DOUBLE) > 0.15e0 THEN 'too_many_unsure' ELSE '' END"


_ROOM = "(adding AND len(held) BETWEEN 1 AND 2)"


@query("stream_lot_pool", f"""WITH RECURSIVE k0 AS (SELECT *, CAST(json_extract_string(props,'$.k') AS INTEGER) AS k0 FROM events), ph AS (SELECT user_id, ts, event_id, CASE WHEN k0 >= 97 THEN 'dark_lot' WHEN k0 >= 90 THEN 'retake' ELSE 'result' END AS kind, event_type IN ('view','click','purchase') AS adding,
  CAST(20+k0 AS BIGINT) AS t, CAST(floor((20+k0)*CASE WHEN event_type='error' THEN 0.5e0 WHEN event_type='click' THEN 0.1e0 ELSE 0.02e0 END) AS BIGINT) AS d, CASE WHEN value >= 150 THEN CAST(floor((20+k0)*0.3e0) AS BIGINT) ELSE 1 END AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM k0),
 st AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, 0 AS lot_no, CAST([] AS STRUCT(d BIGINT, u BIGINT, t BIGINT)[]) AS held, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS kind FROM ph UNION ALL
  SELECT st.user_id, ph.k, CASE WHEN ph.kind='dark_lot' THEN lot_no+1 WHEN {_ROOM} THEN lot_no ELSE lot_no+(len(held) > 0)::INT END,
   CASE WHEN ph.kind='dark_lot' THEN CAST([] AS STRUCT(d BIGINT, u BIGINT, t BIGINT)[]) WHEN ph.kind='retake' THEN CASE WHEN {_ROOM} THEN held ELSE CAST([] AS STRUCT(d BIGINT, u BIGINT, t BIGINT)[]) END
    WHEN {_ROOM} THEN list_append(held, {{'d': ph.d, 'u': ph.u, 't': ph.t}}) ELSE [{{'d': ph.d, 'u': ph.u, 't': ph.t}}] END, ph.ts, ph.event_id, ph.kind FROM st JOIN ph ON ph.user_id=st.user_id AND ph.k=st.k+1),
 s1 AS (SELECT *, CAST(coalesce(list_sum(list_transform(held, lambda x: x.t)),0) AS BIGINT) AS total, CAST(coalesce(list_sum(list_transform(held, lambda x: x.d)),0) AS BIGINT) AS defects, CAST(coalesce(list_sum(list_transform(held, lambda x: x.u)),0) AS BIGINT) AS unsure FROM st WHERE k > 0),
 s2 AS (SELECT *, CASE WHEN kind='dark_lot' THEN 'dark_lot' WHEN kind='retake' THEN '' ELSE CASE WHEN ({_reason('total', 'defects', 'unsure')}) <> '' THEN {_reason('total', 'defects', 'unsure')}
   ELSE coalesce(list_filter(list_transform(held, lambda x: {_reason('x.t', 'x.d', 'x.u')}), lambda r: r <> '')[1], '') END END AS reason FROM s1)
 SELECT user_id, ts, event_id, kind, lot_no, CAST(len(held) AS INTEGER) AS handfuls, total, defects, unsure, CASE WHEN kind='retake' THEN 'retake' WHEN reason <> '' THEN 'unsure' WHEN defects/CAST(total-unsure AS DOUBLE) < 0.05e0 THEN 'clean' WHEN defects/CAST(total-unsure AS DOUBLE) <= 0.2e0 THEN 'some' ELSE 'many' END AS band, reason FROM s2""")
def stream_lot_pool(t):
    """Stateful pooling with veto, retake and dark-lot reset."""
    return S.drain(S.pool_lots(S.photo_events(stream(t))))


@query("stream_dedupe", """WITH d AS (SELECT md5(concat_ws('|', CAST(user_id AS VARCHAR), event_type, props)) AS digest, count(*) AS n FROM events GROUP BY 1) SELECT digest FROM d""")
def stream_dedupe(t):
    """Content-hash ingest; no hash is forgotten."""
    return S.drain(S.distinct_ingest(stream(t))).select("digest")
