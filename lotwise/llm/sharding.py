"""Balanced shards by sampled splitters.

Records have an order: a 52-bit number of the text's digest, then the id. Equal texts are neighbours and so share a
shard unless a boundary falls among them. Keys are drawn with a chance in proportion to their record's size (the draw
is a hash, so reruns agree), quantiles of the draws are the splitters of narrow ranges, and records are dealt by range.
A range that turns out too full gets further splitters drawn within it; the id belongs to the key, so a text that holds
a third of all rows is divided too. Every range then numbers its own records; with the ranges' totals before it, each
record knows its place among all bytes, and its shard is the one that holds the middle of the record. So the shards'
sizes differ by little more than one record, whatever the sample was.

The driver holds at most ``RANGES`` splitters with ``DRAWS`` draws each, and one total per range. Null texts have size
1; null ids come first. Repeated rows are kept, one place each. Extra columns pass
through, but for those named as the result's own, which are replaced; an empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.shared import written

SHARDS = 8
RANGES = 1024
RANGE_BYTES = 2 << 20
DRAWS = 32
FULL = 2.0  # times the wanted size from which a range is divided again


class Splitters:
    """Sorted (key, id) pairs; ``find`` gives the number of splitters at or before each pair."""

    def __init__(self, pairs):
        pairs = sorted(set(pairs))
        self.k = np.array([p[0] for p in pairs], np.int64)
        self.d = np.array([p[1] for p in pairs], np.int64)
        self.pairs = pairs

    def find(self, k: np.ndarray, d: np.ndarray) -> np.ndarray:
        n = len(self.k)
        late = np.concatenate((np.zeros(n, np.int8), np.ones(len(k), np.int8)))
        order = np.lexsort((late, np.concatenate((self.d, d)), np.concatenate((self.k, k))))
        before = np.empty(n + len(k), np.int64)
        before[order] = np.cumsum(order < n)
        return before[n:]


def _ranged(rows: DataFrame, splitters: Splitters) -> DataFrame:
    """Adds ``_range`` by the columns _k and _d."""

    def run(batches):
        for b in batches:
            k, d = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("_k", "_d"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(splitters.find(k, d))], [*b.schema.names, "_range"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, _range long")


def draw_splitters(keys: DataFrame, total: int, range_bytes: int = RANGE_BYTES, most: int = RANGES, draws: int = DRAWS, seed: int = 7) -> tuple[Splitters, pd.DataFrame]:
    """Splitters over a table (_k, _d, _size) and each range's (rows, bytes)."""
    wanted = max(range_bytes, -(-total // most))

    def drawn(rows: DataFrame, per_byte: float, seed: int):
        chance = F.col("_size") * F.lit(per_byte)
        u = F.xxhash64("_k", "_d", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
        return rows.where(u < chance)

    def cut(sample: list, parts: int) -> list:
        sample = sorted(sample)
        return [sample[i * len(sample) // parts] for i in range(1, parts)] if len(sample) >= parts > 1 else sample if parts > 1 else []

    first = [(r["_k"], r["_d"]) for r in drawn(keys, draws / wanted, seed).select("_k", "_d").distinct().collect()]
    splitters = Splitters(cut(first, -(-total // wanted)))
    for again in range(1, 6):
        placed = _ranged(keys, splitters)
        held = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("rows"), F.sum("_size").alias("bytes"), F.max("_size").alias("largest")).toPandas().sort_values("_range")
        full = held[(held.bytes > FULL * wanted + held.largest) & (held.rows > 1)]
        if full.empty:
            break
        some = drawn(placed.where(F.col("_range").isin([int(x) for x in full["_range"]])), draws / wanted, seed + again)
        more = some.select("_range", "_k", "_d").distinct().collect()
        parts = dict(zip(full["_range"], np.ceil(full.bytes / wanted).astype(int)))
        extra = [p for r in parts for p in cut([(x["_k"], x["_d"]) for x in more if x["_range"] == r], parts[r])]
        if not set(extra) - set(splitters.pairs):
            break
        splitters = Splitters(splitters.pairs + extra)
    else:
        held = _ranged(keys, splitters).groupBy("_range").agg(F.count(F.lit(1)).alias("rows"), F.sum("_size").alias("bytes")).toPandas().sort_values("_range")
    return splitters, held[["_range", "rows", "bytes"]]


def ordered(rows: DataFrame, splitters: Splitters, held: pd.DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """Deals rows by range, sorts them inside it (at last by the columns ``ties``), and adds _row (number from 0) and _before (bytes) over all rows."""
    first_row = dict(zip(held["_range"].tolist(), (held.rows.cumsum() - held.rows).tolist()))
    first_byte = dict(zip(held["_range"].tolist(), (held.bytes.cumsum() - held.bytes).tolist()))

    def number(batches):
        at, row, before = None, 0, 0
        for b in batches:
            r = np.asarray(b.column(b.schema.get_field_index("_range")))
            size = np.asarray(b.column(b.schema.get_field_index("_size")))
            rows_out, before_out = np.empty(len(r), np.int64), np.empty(len(r), np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(r)) + 1).tolist(), len(r)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if r[s] != at:
                    at = r[s]
                    row, before = first_row[int(at)], first_byte[int(at)]
                ends = before + np.cumsum(size[s:e])
                rows_out[s:e] = np.arange(row, row + e - s)
                before_out[s:e] = ends - size[s:e]
                row, before = row + e - s, int(ends[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows_out), pa.array(before_out)], [*b.schema.names, "_row", "_before"])

    dealt = _ranged(rows, splitters).repartition("_range").sortWithinPartitions("_range", "_k", "_d", "_size", *ties)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    return dealt.mapInArrow(number, f"{fields}, _row long, _before long")


def shard_records(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All columns of ``docs`` with ``size`` (UTF-8 bytes and 1), ``shard`` and ``slot``; shards are near equal in bytes."""
    docs = docs.drop("size", "shard", "slot", "_k", "_d", "_size", "_range", "_row", "_before")
    size = (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long")
    k = F.conv(F.substring(F.md5(F.coalesce(F.col(text_col), F.lit(""))), 1, 13), 16, 10).cast("long")
    d = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    keys = written(docs.select(k.alias("_k"), d.alias("_d"), size.alias("_size")), "shard-keys")
    total = keys.agg(F.sum("_size")).first()[0] or 0
    splitters, held = draw_splitters(keys, total, range_bytes)
    middle = F.least(F.lit(shards - 1), F.floor((F.col("_before") + F.col("_size") / 2) * shards / F.lit(float(max(1, total))))).cast("int")
    counts = {r["shard"]: r["n"] for r in ordered(keys, splitters, held).groupBy(middle.alias("shard")).agg(F.count(F.lit(1)).alias("n")).collect()}
    begins = [sum(counts.get(i, 0) for i in range(s)) for s in range(shards)]
    rows = docs.select("*", k.alias("_k"), d.alias("_d"), size.alias("_size"))
    out = ordered(rows, splitters, held).withColumn("_shard", middle)
    slot = F.col("_row") - F.element_at(F.array(*[F.lit(b) for b in begins]).cast("array<bigint>"), F.col("_shard") + 1)
    return out.select(*docs.columns, F.col("_size").alias("size"), F.col("_shard").alias("shard"), slot.alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, in slot order within a file."""
    sharded.write.partitionBy("shard").option("compression", "zstd").parquet(path)
