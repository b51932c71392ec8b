"""Nearest neighbours by inner product: a hierarchical navigable small-world graph per shard, shard results merged.

Vectors are dealt to shards of about ``SHARD_ROWS`` rows by a hash of their id, so a hot label or many copies spread
evenly. A shard's graph is built row by row in the order of a hash: a row links to ``LINKS`` neighbours among the rows
before it, chosen for closeness and spread, and they link back, dropping their worst links beyond twice that. Upper
levels hold an ever smaller share of the rows. Since a shard is small, the candidates of each insertion are found by
blocked matrix products rather than by searching the half-built graph. A vector's inner product becomes a distance by
one more coordinate that makes all of a shard's vectors equally long. The graph is stored as flat arrays: per level the
rows and a table of neighbours, -1 where there is none.

Queries go in blocks to every shard (they are a stated set, held against all rows); a block is searched at once, greedy
on the upper levels, with a beam of ``BEAM`` on the lowest. The best of every shard are scored on the original vectors
in double precision and merged with ties to smaller ids.

Equal vectors of a shard are one node of its graph, whose members are all reported, so copies can't fill a beam. Null,
zero and non-finite vectors take no part, nor do rows with a null id or of another length than the query. Extra columns
are ignored; an empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.shared import numbers, pack, planes, unpack, written
from lotwise.llm.vector_dedup import usable

SHARD_ROWS = 8192
LINKS = 16
CANDIDATES = 48
BEAM = 96
QUERY_BLOCK = 512
NEAREST = 20


def _spread(x: np.ndarray, candidates: np.ndarray, near: np.ndarray, most: int) -> list[int]:
    """Of candidates in order of closeness: those closer to the row than to any already chosen, then the nearest others."""
    pairs = x[candidates] @ x[candidates].T
    chosen: list[int] = []
    closest = np.full(len(candidates), -np.inf)
    for i in range(len(candidates)):
        if near[i] > closest[i]:
            chosen.append(i)
            if len(chosen) == most:
                break
            np.maximum(closest, pairs[i], out=closest)
    if len(chosen) < most:
        taken = set(chosen)
        chosen += [i for i in range(len(candidates)) if i not in taken][: most - len(chosen)]
    return candidates[chosen].tolist()


def _level(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Neighbour table of one level over ``rows`` (in insertion order), in positions among ``rows``."""
    own, n = x[rows], len(rows)
    table: list[list[int]] = [[] for _ in range(n)]
    cap = 2 * LINKS
    for at in range(0, n, 256):
        stop = min(n, at + 256)
        near = own[at:stop] @ own[:stop].T
        for i in range(at, stop):
            if not i:
                continue
            row = near[i - at, :i]
            best = np.argpartition(-row, CANDIDATES)[:CANDIDATES] if i > CANDIDATES else np.arange(i)
            best = best[np.argsort(-row[best], kind="stable")]
            table[i] = _spread(own, best, row[best], LINKS)
            for j in table[i]:
                back = table[j]
                back.append(i)
                if len(back) >= 2 * cap:
                    c = np.array(back)
                    s = own[c] @ own[j]
                    order = np.argsort(-s, kind="stable")
                    table[j] = _spread(own, c[order], s[order], cap)
    out = np.full((n, cap), -1, np.int32)
    for j, back in enumerate(table):
        if len(back) > cap:
            c = np.array(back)
            s = own[c] @ own[j]
            order = np.argsort(-s, kind="stable")
            back = _spread(own, c[order], s[order], cap)
        out[j, : len(back)] = back
    return out


class Graph:
    """A shard's graph: vectors with the evening coordinate, levels of (rows, neighbours), members of every node."""

    def __init__(self, vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.x, self.levels = vectors, levels

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 3) -> Graph:
        v = vectors.astype(np.float32)
        squares = (v * v).sum(1)
        x = np.concatenate((v, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]), axis=1)
        heights = np.floor(-np.log(1 - np.random.default_rng(seed).random(len(v))) / np.log(LINKS)).astype(int)
        levels, rows = [], np.arange(len(v))
        while len(rows):
            levels.append((rows.astype(np.int32), _level(x, rows)))
            rows = np.flatnonzero(heights >= len(levels))
        return cls(x, levels)

    def pack(self) -> bytes:
        shape = np.array([*self.x.shape, *(len(r) for r, _ in self.levels)], np.int64)
        return pack(shape, self.x, *(planes(a.ravel().view(np.uint32)) for level in self.levels for a in level))

    @classmethod
    def unpack(cls, value: bytes) -> Graph:
        shape, x, *flat = unpack(value)
        shape = np.frombuffer(shape, np.int64)
        x = np.frombuffer(x, np.float32).reshape(shape[0], shape[1])
        flat = [numbers(f).view(np.int32) for f in flat]
        return cls(x, [(flat[2 * i], flat[2 * i + 1].reshape(n, -1)) for i, n in enumerate(shape[2:])])

    def search(self, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Nodes nearest to each query, best first, -1 where there are fewer than ``beam``."""
        q = np.concatenate((queries.astype(np.float32), np.zeros((len(queries), 1), np.float32)), axis=1)
        at = np.zeros(len(q), np.int64)  # the first row of the top level
        for depth in range(len(self.levels) - 1, 0, -1):
            rows, table = self.levels[depth]
            score = (self.x[rows[at]] * q).sum(1)
            active = np.arange(len(q))
            while len(active):
                around = table[at[active]]
                s = np.einsum("qmd,qd->qm", self.x[rows[np.maximum(around, 0)]], q[active])
                s[around < 0] = -np.inf
                best = s.argmax(1)
                top = s[np.arange(len(active)), best]
                better = top > score[active]
                active = active[better]
                at[active] = around[better, best[better]]
                score[active] = top[better]
            below = self.levels[depth - 1][0]
            at = np.searchsorted(below, rows[at])
        return self._beam(q, at, beam)

    def _beam(self, q: np.ndarray, start: np.ndarray, beam: int) -> np.ndarray:
        n, m = len(self.x), len(q)
        table = self.levels[0][1]
        seen = np.zeros((m, n), bool)
        nodes = np.full((m, beam), -1, np.int64)
        scores = np.full((m, beam), -np.inf, np.float32)
        done = np.ones((m, beam), bool)
        lane = np.arange(m)
        nodes[:, 0], scores[:, 0], done[:, 0] = start, (self.x[start] * q).sum(1), False
        seen[lane, start] = True
        active = lane
        while len(active):
            open_ = np.where(done[active], -np.inf, scores[active])
            pick = open_.argmax(1)
            going = open_[np.arange(len(active)), pick] > -np.inf
            active, pick = active[going], pick[going]
            if not len(active):
                break
            done[active, pick] = True
            around = table[nodes[active, pick]]
            fresh = (around >= 0) & ~seen[active[:, None], np.maximum(around, 0)]
            i, j = np.nonzero(fresh)
            seen[active[i], around[i, j]] = True
            s = np.full(around.shape, -np.inf, np.float32)
            s[i, j] = (self.x[around[i, j]] * q[active[i]]).sum(1)
            all_s = np.concatenate((scores[active], s), axis=1)
            all_n = np.concatenate((nodes[active], around), axis=1)
            all_d = np.concatenate((done[active], ~fresh), axis=1)
            keep = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            scores[active] = np.take_along_axis(all_s, keep, 1)
            nodes[active] = np.take_along_axis(all_n, keep, 1)
            done[active] = np.take_along_axis(all_d, keep, 1) | np.isneginf(scores[active])
        order = np.argsort(-scores, axis=1, kind="stable")
        nodes, scores = np.take_along_axis(nodes, order, 1), np.take_along_axis(scores, order, 1)
        return np.where(np.isneginf(scores), -1, nodes)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, dims, graph): every usable row is in one shard. The table is written to the shared folder."""
    vec = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), F.size(vector_col).alias("dims"))
    rows = written(rows, "index-rows")
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(17)), F.lit(shards)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, x = np.asarray(table.column("id")), _matrix(table.column("vec").combine_chunks())
        nodes, member = np.unique(x, axis=0, return_inverse=True)
        mixed = np.random.default_rng(len(nodes)).permutation(len(nodes))  # np.unique sorts; insertion is in no order
        place = np.empty(len(nodes), np.int64)
        place[mixed] = np.arange(len(nodes))
        member = place[member.ravel()]
        order = np.lexsort((ids, member))
        ends = np.cumsum(np.bincount(member, minlength=len(nodes)))
        value = pack(Graph.build(nodes[mixed]).pack(), ids[order], ends, nodes[mixed])
        return pa.table([table.column("shard")[:1], table.column("dims")[:1], pa.array([value], pa.binary())], ["shard", "dims", "graph"])

    return written(dealt.select("shard", "dims", "id", "vec").groupBy("shard", "dims").applyInArrow(build, "shard int, dims int, graph binary"), "index")


def search(index: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every query, itself left out."""
    vec = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    rows = queries.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), F.size(vector_col).alias("dims"))
    rows = written(rows, "queries")
    blocks = max(1, -(-rows.count() // QUERY_BLOCK))
    packed = rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit(29)), F.lit(blocks)).cast("int"))

    def bundle(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("vec").combine_chunks())
        return pa.table([table.column("dims")[:1], pa.array([pack(np.asarray(table.column("id")), x)], pa.binary())], ["dims", "queries"])

    bundles = packed.groupBy("part", "dims").applyInArrow(bundle, "dims int, queries binary")

    def run(batches):
        for batch in batches:
            for graph, bundle in zip(batch.column(0), batch.column(1)):
                packed_graph, ids, ends, nodes = unpack(graph.as_py())
                ids, ends = np.frombuffer(ids, np.int64), np.frombuffer(ends, np.int64)
                g = Graph.unpack(packed_graph)
                nodes = np.frombuffer(nodes, np.float64).reshape(len(ends), -1)
                q_ids, q = unpack(bundle.as_py())
                q_ids = np.frombuffer(q_ids, np.int64)
                q = np.frombuffer(q, np.float64).reshape(len(q_ids), -1)
                found = g.search(q, max(beam, k + 1))
                for i, own in enumerate(found):
                    own = own[own >= 0]
                    score = (nodes[own] * q[i]).sum(1)
                    order = np.argsort(-score, kind="stable")
                    own, score = own[order], score[order]
                    starts = np.where(own > 0, ends[own - 1], 0)
                    # k + 1 members of a node are enough: the smallest ids, one of which may be the query's own
                    n = np.minimum(ends[own] - starts, k + 1)
                    members = np.concatenate([ids[s : s + c] for s, c in zip(starts, n)]) if len(own) else ids[:0]
                    values = np.repeat(score, n)
                    fine = members != q_ids[i]
                    members, values = members[fine], values[fine]
                    top = np.lexsort((members, -values))[:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), q_ids[i])), pa.array(members[top]), pa.array(values[top])], ["query_id", "vec_id", "score"])

    work = index.join(bundles, "dims").select("graph", "queries")  # every block of queries against every shard
    hits = work.repartition(max(2, index.sparkSession.sparkContext.defaultParallelism) * 2).mapInArrow(run, "query_id long, vec_id long, score double")
    best = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("all"))  # k per shard
    out = best.select("query_id", F.posexplode(F.slice("all", 1, k)).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score"))
