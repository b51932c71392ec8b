"""Helpers that several operators of this package share."""

from __future__ import annotations

import sys
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.session import shared_folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder below the one the cluster shares."""
    return f"{shared_folder(spark).rstrip('/')}/lotwise-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors, is computed once."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_state(name: str, make):
    """An object that lives as long as the Python worker, so that later tasks on it find it filled."""
    holder = sys.modules.setdefault("_lotwise_worker_state", types.ModuleType("_lotwise_worker_state"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def byte_slices(batch: pa.RecordBatch, column: str, most: int):
    """Cuts a batch so that a slice holds at most ``most`` bytes of the column, or one row."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def gather(blob: np.ndarray, starts: np.ndarray, lengths: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """The pieces ``blob[starts[i] : starts[i] + lengths[i]]`` for every i of ``picks``, one after the other."""
    n = lengths[picks]
    ends = np.cumsum(n)
    if not len(ends) or ends[-1] == 0:
        return blob[:0]
    kind = np.int32 if max(len(blob), ends[-1]) < 1 << 31 else np.int64
    at = np.repeat((starts[picks] - (ends - n)).astype(kind), n)
    at += np.arange(ends[-1], dtype=kind)
    return blob[at]


def pack(*arrays) -> bytes:
    """Arrays and byte strings as one compressed value."""
    import zstandard

    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def unpack(value: bytes) -> list[memoryview]:
    import zstandard

    raw = memoryview(zstandard.ZstdDecompressor().decompress(value))
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    sizes = np.frombuffer(raw[8 : 8 + 8 * n], np.int64)
    ends = 8 + 8 * n + np.cumsum(sizes)
    return [raw[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist())]


def planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers byte by byte: the high bytes are mostly zero and cost nothing."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def numbers(parts) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(parts, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: (node, root), root the smallest node reachable, for linked nodes only.

    Alternates the two star steps: every node sends its larger neighbours to the smallest one it knows, then its smaller
    ones. Each round is a grouped minimum (combined before the shuffle) and a join; a round's links are written to the
    shared folder. The joins meet on a derived key, so that both sides are dealt anew and a hub's rows can be split."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    edges = written(links.where(F.col(a) != F.col(b)).select(hi.alias("hi"), lo.alias("lo")).distinct(), "links")
    mark = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")).alias("h")).first()
        if state["n"] == 0 or (state["n"], state["h"]) == mark:
            break
        mark = (state["n"], state["h"])
        near = edges.select(F.col("lo").alias("u"), F.col("lo").alias("m")).unionByName(edges.select(F.col("hi").alias("u"), F.col("lo").alias("m")))
        low = near.groupBy("u").agg(F.min("m").alias("m"))
        large = _meet(edges, low, "lo").select("hi", F.col("m").alias("lo"))
        large = written(large.where("hi <> lo").distinct(), "links")
        low = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = _meet(large, low, "hi").select(F.col("lo").alias("x"), "m").where("x <> m").unionByName(low.select(F.col("u").alias("x"), "m"))
        edges = written(small.select(F.greatest("x", "m").alias("hi"), F.least("x", "m").alias("lo")).distinct(), "links")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _meet(edges: DataFrame, low: DataFrame, on: str) -> DataFrame:
    left = edges.withColumn("_k", F.col(on).bitwiseXOR(F.lit(1)))
    right = low.select(F.col("u").bitwiseXOR(F.lit(1)).alias("_k"), "m")
    return left.join(right, "_k").drop("_k")
