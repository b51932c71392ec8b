"""SimHash fingerprints and near-duplicate groups by deletion variants of few segments.

A fingerprint of 64 bits is cut into ``SEGMENTS`` = 3 segments. Two fingerprints at 4 or fewer differing bits have one
segment that differs in at most one bit (3 segments of 2 bits or more would make 6). So every distinct fingerprint is
indexed under each segment with one bit taken out, 64 variants in all, and an equality join on the variants finds every
pair; the full distance is checked in the join itself. A pair is reported by one variant only: that of its first
segment that differs in at most one bit, with the differing bit (or, if there is none, the segment's first bit) out.

Null and empty texts have fingerprint zero and link with each other. Equal fingerprints are joined once, however
many documents share them. Extra columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.scale import attach, hot_groups
from lotwise.llm.shared import components, written

SEGMENTS = ((0, 21), (21, 42), (42, 64))
BITS = 4
WORDS = 4
SEED = 42
HOT = 100_000  # rows of one fingerprint beyond which its component is attached by broadcast


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


MASKS = [sum(1 << b for b in range(lo, hi)) for lo, hi in SEGMENTS]
SEGMENT_OF = [s for s, (lo, hi) in enumerate(SEGMENTS) for _ in range(lo, hi)]


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Of lower-cased (A-Z) words split at ASCII white space; shingles count as often as they occur."""
    import xxhash

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(line, seed)]
    else:
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        starts = np.concatenate(([0], gaps + 1))[: len(tokens) - words + 1].tolist()
        ends = np.concatenate((gaps, [len(line)]))[words - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], seed) for a, b in zip(starts, ends)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a very long text is counted in pieces
        part = np.array(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def linked(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (column fp) at ``BITS`` or fewer differing bits, each once."""
    mask = F.array(*[F.lit(_signed(MASKS[SEGMENT_OF[b]] & ~(1 << b))) for b in range(64)])
    rows = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    rows = rows.withColumn("variant", F.col("fp").bitwiseAND(F.element_at(mask, F.col("bit") + 1)))
    a, b = rows.alias("a"), rows.hint("merge").alias("b")  # 64 rows of each: never one side by broadcast
    diff = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    parts = [F.bit_count(diff.bitwiseAND(F.lit(_signed(m)))) for m in MASKS]
    first = F.when(parts[0] <= 1, 0).when(parts[1] <= 1, 1).otherwise(2)
    segment = F.when(F.col("a.bit") < SEGMENTS[0][1], 0).when(F.col("a.bit") < SEGMENTS[1][1], 1).otherwise(2)
    out = F.element_at(F.array(*[F.lit(_signed(1 << i)) for i in range(64)]), F.col("a.bit") + 1)
    own = F.element_at(F.array(*[F.lit(_signed(m)) for m in MASKS]), segment + 1)
    lowest = F.col("a.bit").isin(*[lo for lo, _ in SEGMENTS])
    once = (segment == first) & ((diff.bitwiseAND(own) == out) | ((diff.bitwiseAND(own) == 0) & lowest))
    same = (F.col("a.bit") == F.col("b.bit")) & (F.col("a.variant") == F.col("b.variant"))
    return a.join(b, same & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(diff) <= BITS) & once).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id: the smallest id reachable over links, itself included)."""
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    groups = written(fps.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "fp-groups")
    pairs = linked(groups.select("fp"))
    roots = components(pairs)
    # components of fingerprints first; the smallest id of each is taken over all its fingerprints
    grouped = groups.join(roots, groups.fp == roots.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    grouped = written(grouped, "fp-roots")
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.select("fp", F.col("root")).join(least, "root").select("fp", "component_id")
    out = attach(fps, named, ["fp"], hot_groups(fps, ["fp"], HOT))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
