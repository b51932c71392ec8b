"""A mix of sources to target weights, drawn in blocks of words.

Each source's words, in document order, are packed into blocks of ``BLOCK_WORDS``. The mix has as many blocks of a
source as its target holds. Every output shard draws its sources by a multinomial from a generator seeded with the
shard's number; a source that was drawn more often than its target allows hands its last slots to those drawn too
seldom, so the totals are the targets' own. A source's k-th slot takes the block at place k of a pseudorandom
permutation of its blocks, a new permutation for every pass over them, and slots and blocks are joined by index.
Nothing depends on partitions: reruns agree.

A source without words has target 0. Null and empty texts have no words and are never taken. No block is taken more
than 3 times, since no target is above 3 times its source. Sources are few (their weights and targets are on the
driver); they go by code point, null last. Repeated rows are documents of their own. Extra columns are ignored."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.scale import prefix_sums
from lotwise.llm.shared import written
from lotwise.llm.sharding import draw_splitters, ordered

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 64
SHARD_BLOCKS = 4096
MOST = 3.0
SEED = 11


def cycle_weights(n: int) -> list[float]:
    return [(5.0, 2.0, 1.0)[i % 3] for i in range(n)]


def targets(sizes: list[float], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the whole by weight; a target stops at ``most`` times its source and the rest is shared again."""
    sizes, weights = np.array(sizes, float), np.array(weights, float)
    out, open_ = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    left = sizes.sum()
    while open_.any():
        share = np.where(open_, left * weights / weights[open_].sum(), 0)
        over = open_ & (share > most * sizes)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = most * sizes[over]
        left -= out[over].sum()
        open_ &= ~over
    return out.tolist()


def permuted(index: np.ndarray, n: int, key: np.ndarray) -> np.ndarray:
    """Place of every index under a keyed permutation of 0 .. n - 1: four mixing rounds over the two halves of the
    number, walked until the result is below n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)

    def rounds(x, key):
        a, b = x >> np.uint64(half), x & low
        for r in range(4):
            m = (b + key + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            m = (m ^ (m >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((m >> np.uint64(32)) & low)
        return (a << np.uint64(half)) | b

    key = key.astype(np.uint64)
    out = rounds(index.astype(np.uint64), key)
    wide = np.flatnonzero(out >= n)
    while len(wide):
        out[wide] = rounds(out[wide], key[wide])
        wide = wide[out[wide] >= n]
    return out.astype(np.int64)


class Plan:
    """Sources, targets and block numbers of a mix, and the documents' places in their sources."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Callable[[int], list[float]], block_words: int, carried: tuple[str, ...] = ()):
        self.carried = carried
        size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
        rows = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), *carried), "mix-sizes")
        held = rows.groupBy("source").agg(F.sum("size").alias("n")).collect()
        held = sorted(held, key=lambda r: (r["source"] is None, r["source"] or ""))
        spark = docs.sparkSession
        self.sizes = [r["n"] for r in held]
        self.targets = targets(self.sizes, weights(len(held)))
        self.blocks = [-(-n // block_words) for n in self.sizes]
        self.slots = [round(t * b / n) if n else 0 for t, b, n in zip(self.targets, self.blocks, self.sizes)]
        names = pd.DataFrame({"name": pd.Series([r["source"] for r in held], dtype=object), "source_no": range(len(held)), "begin": np.cumsum([0, *self.sizes])[:-1].astype(np.int64) if held else [], "source_size": self.sizes, "target": self.targets})
        table = spark.createDataFrame(names.to_dict("records"), "name string, source_no long, begin long, source_size long, target double")
        rows = rows.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("name")))  # one line per source
        d = F.coalesce("doc_id", F.lit(-(1 << 63)))
        keys = rows.select("doc_id", "source", "source_size", "target", "begin", F.col("source_no").alias("_k"), d.alias("_d"), F.col("size").alias("_size"), *carried)
        keys = written(keys, "mix-keys")
        splitters, totals = draw_splitters(keys.select("_k", "_d", "_size"), sum(self.sizes), 1 << 18)
        placed = ordered(keys, splitters, totals, carried)
        self.documents = written(placed.select("_row", "doc_id", "source", "source_size", "target", F.col("_k").alias("source_no"), F.col("_size").alias("size"), (F.col("_before") - F.col("begin")).alias("at"), *carried), "mix-documents")
        self.block_words = block_words

    def spans(self) -> DataFrame:
        """(source_no, block, _row, doc_id, first, last, columns carried): words first .. last - 1 of a document lie in the block."""
        w = self.block_words
        rows = self.documents.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / w), F.floor((F.col("at") + F.col("size") - 1) / w))))
        first = F.greatest(F.col("block") * w - F.col("at"), F.lit(0))
        last = F.least((F.col("block") + 1) * w - F.col("at"), F.col("size"))
        return rows.select("source_no", "block", "_row", "doc_id", first.alias("first"), last.alias("last"), *self.carried)

    def draws(self, seed: int = SEED, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
        """(out_shard, slot, source_no, pass, block): the blocks of every output shard."""
        spark = self.documents.sparkSession
        total = sum(self.slots)
        share = np.array(self.slots, float) / max(1, total)
        shards = -(-total // shard_blocks)

        def counts(batches):
            for b in batches:
                out = []
                for j in b.column(0).to_pylist():
                    n = min(shard_blocks, total - j * shard_blocks)
                    drawn = np.random.default_rng([seed, j]).multinomial(n, share)
                    out += [(j, s, int(c)) for s, c in enumerate(drawn)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["out_shard", "source_no", "n"])

        drawn = written(spark.range(shards).mapInArrow(counts, "out_shard long, source_no long, n long"), "mix-counts")
        got = {r["source_no"]: r["n"] for r in drawn.groupBy("source_no").agg(F.sum("n").alias("n")).collect()}
        drawn_n = np.array([got.get(s, 0) for s in range(len(self.slots))], np.int64)
        wanted = np.array(self.slots, np.int64)
        over, under = np.maximum(drawn_n - wanted, 0), np.maximum(wanted - drawn_n, 0)
        over_at, under_ends = np.cumsum(over) - over, np.cumsum(under)
        blocks = np.array(self.blocks, np.int64)

        def slots(batches):
            for b in batches:
                j, s, n, cum = (np.asarray(b.column(i)).astype(np.int64) for i in range(4))
                jj, ss = np.repeat(j, n), np.repeat(s, n)
                ends = np.cumsum(n)
                k = np.repeat(cum - ends, n) + np.arange(ends[-1] if len(ends) else 0)
                spare = np.flatnonzero(k >= wanted[ss]) if len(k) else np.zeros(0, np.int64)
                if len(spare):
                    u = over_at[ss[spare]] + k[spare] - wanted[ss[spare]]
                    t = np.searchsorted(under_ends, u, "right")
                    k[spare] = drawn_n[t] + u - (under_ends[t] - under[t])
                    ss[spare] = t
                block = np.empty(len(k), np.int64)
                turn = np.zeros(len(k), np.int64)
                for source in np.unique(ss):
                    own = np.flatnonzero(ss == source)
                    turn[own], place = np.divmod(k[own], blocks[source])
                    key = (turn[own] + source * 1009 + seed * 1000003).astype(np.uint64)
                    block[own] = permuted(place, int(blocks[source]), key)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (jj, k, ss, turn, block)], ["out_shard", "k", "source_no", "pass", "block"])

        placed = prefix_sums(drawn, ["source_no"], "out_shard", ["n"]).select("out_shard", "source_no", "n", "cum_n")
        rows = placed.mapInArrow(slots, "out_shard long, k long, source_no long, pass long, block long")
        slot = F.xxhash64("out_shard", "source_no", "k", F.lit(seed))  # the order inside an output shard
        return rows.select("out_shard", slot.alias("slot"), "source_no", "pass", "block")

    def blocks_of_mix(self) -> DataFrame:
        """The mix: (out_shard, slot, source_no, pass, block, doc_id, first, last), a line per document in a block."""
        return self.draws().hint("merge").join(self.spans(), ["source_no", "block"])

    def taken(self) -> DataFrame:
        """(_row, taken): words of each document in the mix, repeats counted, for documents with any."""
        times = self.draws().groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
        words = self.spans().join(times.hint("merge"), ["source_no", "block"])  # many rows from few: not one to broadcast
        return words.groupBy("_row").agg(F.sum((F.col("last") - F.col("first")) * F.col("times")).alias("taken"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=cycle_weights, block_words: int = BLOCK_WORDS, carried: tuple[str, ...] = ()) -> Plan:
    return Plan(docs, id_col, text_col, source_col, weights, block_words, carried)


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every document."""
    p = plan(docs)
    rows = p.documents.join(p.taken().hint("merge"), "_row", "left")
    return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes words of, each with the words taken as its text: first pass first, neighbouring
    blocks with the white space between them, others on lines of their own. ``n_chars`` follows the text. Rows are told
    apart by their texts' digest and a written number, so ids may be null or repeated."""
    columns = docs.columns
    docs = written(docs.withColumn("_tie", F.xxhash64("text")).withColumn("_key", F.monotonically_increasing_id()), "mix-rows")
    p = plan(docs, carried=("_tie", "_key"))
    pieces = p.blocks_of_mix().groupBy("_key").agg(F.collect_list(F.struct("pass", "first", "last")).alias("_pieces"))  # a document's own blocks
    rows = docs.join(pieces.hint("merge"), "_key")
    at, text_at = rows.columns.index("_pieces"), rows.columns.index("text")

    def rebuild(batches):
        import re

        word = re.compile(WORD)
        for b in batches:
            texts = []
            for text, own in zip(b.column(text_at), b.column(at)):
                text, places = text.as_py(), None
                runs: list[list[int]] = []
                for turn, first, last in sorted((x["pass"], x["first"], x["last"]) for x in own.as_py()):
                    if runs and runs[-1][0] == turn and runs[-1][2] == first:
                        runs[-1][2] = last
                    else:
                        runs.append([turn, first, last])
                places = [m.span() for m in word.finditer(text)]
                texts.append("\n".join(text[places[first][0] : places[last - 1][1]] for _, first, last in runs))
            columns = [pa.array(texts, pa.string()) if i == text_at else c for i, c in enumerate(b.columns) if i != at]
            yield pa.RecordBatch.from_arrays(columns, [n for n in b.schema.names if n != "_pieces"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[c for c in rows.columns if c != "_pieces"]).schema)
    out = rows.mapInArrow(rebuild, fields)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*columns)
