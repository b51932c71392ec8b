"""Structured Streaming forms of the lot operators. Each has a batch twin with the same column logic."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lotwise import constants as C
from lotwise.operators import verdict as V
from lotwise.session import shared_folder


def event_call() -> Column:
    """Events read as calls: a very large value is unsure, an error is a defect."""
    return F.when(F.col("value") >= 150, C.UNSURE).when(F.col("event_type") == "error", C.DEFECT).otherwise(C.GOOD)


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over everything that is there (availableNow) into a Parquet sink and returns what it wrote.

    Sink and progress log live in the shared folder, so a lost executor replays its batch."""
    base = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


# ---------------------------------------------------------------- windowed verdict

def window_verdict(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Verdict per source and tumbling or sliding window; with ``late`` the window closes behind a watermark."""
    x = events.withColumn("code", event_call()).withColumn("source", F.col("user_id") % 7)
    if late:
        x = x.withWatermark("ts", late)
    counts = V.tally_calls(x, [F.window("ts", size, slide).alias("w"), "source"])
    return V.decide(counts).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "source", *V.COUNTS, "p", "lo", "hi", "unsure_frac", "reason", "band", "about", "can_add")


# ---------------------------------------------------------------- pooled sessions

def session_counts(events: DataFrame, gap: str = "6 hours", late: str | None = None) -> DataFrame:
    """Call counts per user session: results of one user close in time are one pooled lot."""
    x = events.withColumn("code", event_call())
    if late:
        x = x.withWatermark("ts", late)
    c = V.tally_calls(x, ["user_id", F.session_window("ts", gap).alias("w")])
    return c.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), *V.COUNTS)


POOL_OUT = "user_id long, ts timestamp, event_id long, kind string, lot_no int, handfuls int, total long, defects long, unsure long, band string, reason string"
POOL_STATE = "lot_no int, handfuls array<struct<defects:long,unsure:long,total:long>>"


def _decide(total: int, defects: int, unsure: int) -> tuple[str, str]:
    answered = total - unsure
    if answered == 0:
        return "unsure", "too_many_unsure"
    rate = defects / answered
    if rate > C.IMPLAUSIBLE_DEFECT_FRAC:
        return "unsure", "implausible"
    if unsure / total > C.MAX_UNSURE_FRAC:
        return "unsure", "too_many_unsure"
    return ("clean" if rate < C.CLEAN_MAX else "some" if rate <= C.MANY_MIN else "many"), ""


def pool_step(lot_no: int, held: list[dict], kind: str, adding: bool, handful: dict) -> tuple[int, list[dict], str, str]:
    """One photo of a user against the open lot (at most three handfuls).

    A result joins the lot while the user is adding and there is room, else it opens a new lot. A dark lot answers
    'unsure' on its own and clears the lot. A retake keeps the lot only while adding."""
    room = adding and 0 < len(held) < C.MAX_HANDFULS
    if kind == "dark_lot":
        return lot_no + 1, [], "unsure", "dark_lot"
    if kind == "retake":
        return (lot_no, held, "retake", "") if room else (lot_no + (1 if held else 0), [], "retake", "")
    if not room:
        lot_no, held = lot_no + (1 if held else 0), []
    held = [*held, handful]
    band, reason = _decide(*(sum(h[k] for h in held) for k in ("total", "defects", "unsure")))
    if band != "unsure":
        for h in held:
            b, r = _decide(h["total"], h["defects"], h["unsure"])
            if b == "unsure":
                return lot_no, held, b, r
    return lot_no, held, band, reason


def photo_events(events: DataFrame) -> DataFrame:
    """Events read as one photo each: what it showed, whether the user was adding, and its call counts."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(k >= 97, "dark_lot").when(k >= 90, "retake").otherwise("result")
    total = (20 + k).cast("long")
    return events.select(
        "user_id", "ts", "event_id", kind.alias("kind"), F.col("event_type").isin("view", "click", "purchase").alias("adding"), total.alias("total"),
        F.floor(total * F.when(F.col("event_type") == "error", 0.5).when(F.col("event_type") == "click", 0.1).otherwise(0.02)).alias("defects"),
        F.when(F.col("value") >= 150, F.floor(total * 0.3)).otherwise(F.lit(1).cast("long")).alias("unsure"))


def pool_lots(photos: DataFrame) -> DataFrame:
    """Stateful pooling per user. State is the open lot: a number and at most three handfuls."""
    def run(key, batches, state: GroupState):
        lot_no, held = (state.get[0], [dict(h.asDict() if hasattr(h, "asDict") else h) for h in state.get[1]]) if state.exists else (0, [])
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for r in pdf.itertuples(index=False):
            hand = {"defects": int(r.defects), "unsure": int(r.unsure), "total": int(r.total)}
            lot_no, held, band, reason = pool_step(lot_no, held, r.kind, bool(r.adding), hand)
            s = {k: sum(h[k] for h in held) for k in ("total", "defects", "unsure")}
            out.append((key[0], r.ts, r.event_id, r.kind, lot_no, len(held), s["total"], s["defects"], s["unsure"], band, reason))
        state.update((lot_no, [(h["defects"], h["unsure"], h["total"]) for h in held]))
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in POOL_OUT.split(", ")])

    return photos.groupBy("user_id").applyInPandasWithState(run, POOL_OUT, POOL_STATE, "append", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------- history and ingest

HIST_ROW = "array<struct<at:long,event_id:long,id:int,value:string>>"  # times as microseconds, NO_TIME for none; pandas would lose a NaN
HIST_OUT = f"user_id long, version long, kept {HIST_ROW}"
HIST_STATE = f"version long, wiped_at long, wiped_id long, kept {HIST_ROW}"
NO_TIME = -(1 << 63)


def wipe_request() -> Column:
    """Default wipe of a history: a negative value."""
    return F.col("value") < 0


def history_events(events: DataFrame, wipe: Column | None = None) -> DataFrame:
    """Events as history records: (user_id, ts, event_id, id, value, wipe)."""
    w = F.coalesce(wipe_request() if wipe is None else wipe, F.lit(False))
    return events.select("user_id", "ts", "event_id", F.get_json_object("props", "$.k").cast("int").alias("id"), "value", w.alias("wipe"))


def last_n_stream(events: DataFrame, n: int = 5, wipe: Column | None = None) -> DataFrame:
    """Newest n records per user, the newest of each id, none at or before the user's last wipe; (ts, event_id) is the order.

    Emits the user's list after every batch that names the user; the emission with the largest ``version`` is current.
    Neither the number of files nor their order changes the end result: what a user once pushed out of the list is
    older than all that stays, so a late wipe that reaches into the list has wiped it too. State is the version, the
    last wipe and at most n records; the batches of a user are folded one after the other."""
    def run(key, batches, state: GroupState):
        version, wiped_at, wiped_id, kept = state.get if state.exists else (0, None, None, [])
        wiped, kept = (() if wiped_at is None else (wiped_at, wiped_id)), [tuple(r) for r in kept]  # nothing is before ()
        for pdf in batches:
            new = []
            for line in pdf["row"].tolist():
                at, no, wipe, k, value = line.split(",")
                if wipe == "true":
                    wiped = max(wiped, (int(at), int(no)))
                else:
                    new.append((int(at), int(no), k, value))
            newest = {}
            for at, no, k, value in sorted(new, key=lambda r: r[:2], reverse=True):
                if len(newest) == n or (at, no) <= wiped:
                    break
                newest.setdefault(k, (at, no, int(k) if k else None, value or None))
            last = {}
            for r in sorted([*kept, *newest.values()], key=lambda r: r[:2], reverse=True):
                if r[:2] > wiped:
                    last.setdefault(r[2], r)
            kept = list(last.values())[:n]
        state.update((version + 1, *(wiped or (None, None)), kept))
        yield pd.DataFrame({"user_id": [key[0]], "version": [version + 1], "kept": [[dict(zip(("at", "event_id", "id", "value"), r)) for r in kept]]})

    # one column a record: a user costs a conversion per column, however few rows there are
    number = lambda c: F.coalesce(c, F.lit(NO_TIME)).cast("string")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = F.concat_ws(",", number(F.unix_micros("ts")), number(F.col("event_id")), text("wipe"), text("id"), text("value"))
    emitted = history_events(events, wipe).select("user_id", row.alias("row")).groupBy("user_id").applyInPandasWithState(run, HIST_OUT, HIST_STATE, "append", GroupStateTimeout.NoTimeout)
    known = lambda c: F.when(c != NO_TIME, c)
    timed = lambda k: F.struct(F.timestamp_micros(known(k["at"])).alias("ts"), known(k["event_id"]).alias("event_id"), k["id"].alias("id"), k["value"].cast("double").alias("value"))
    return emitted.select("user_id", "version", F.transform("kept", timed).alias("kept"))


def current_history(emitted: DataFrame) -> DataFrame:
    """The lists that ``last_n_stream`` emitted last, one row per record."""
    last = emitted.groupBy("user_id").agg(F.max_by("kept", "version").alias("kept"))
    return last.select("user_id", F.explode("kept").alias("k")).select("user_id", "k.id", "k.event_id", "k.ts", "k.value")


def distinct_ingest(events: DataFrame, late: str | None = None) -> DataFrame:
    """One row of every content hash, however many batches apart its copies come.

    The state then holds every hash seen (keep it in RocksDB on a cluster). With ``late`` a hash is forgotten once the
    watermark has passed it by that much, and a copy that comes later passes again."""
    x = events.withColumn("digest", F.md5(F.concat_ws("|", "user_id", "event_type", "props")))
    return x.withWatermark("ts", late).dropDuplicatesWithinWatermark(["digest"]) if late else x.dropDuplicates(["digest"])
