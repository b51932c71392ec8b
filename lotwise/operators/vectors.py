"""Similarity joins and nearest neighbours over vector columns.

Vectors are compared in tiles: both sides are cut into chunks of bounded size, each pair of chunks is one small
matrix product in one task, and a tile returns only what the caller asked for (a few numbers or k neighbours per
row). No list of pairs is ever written, and no group has to fit into a task.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.graph import _roots, connected
from lotwise.functions.scale import HOT_ROWS, attach, hot_groups  # noqa: F401 (a test lowers the first)
from lotwise.operators.splits import first_k
from lotwise.session import cut_lineage

CHUNK = 2048  # rows of a side of one matrix
TILE = 16  # matrices along a side of a tile: a row travels once per tile
PACK_ROWS = 20_000  # entries of a component that one task walks


def _unit(m: np.ndarray, floor: float = 1e-9) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), floor)


def _matrix(s: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in s.to_numpy()])


def unsent(df: DataFrame) -> DataFrame:
    """``df`` for a join that must not broadcast it: Spark's size estimate counts an array as one element, and an exploded
    row as one row, so that vectors of many times the limit pass for small."""
    return df.hint("merge")


def _empty(names: list[str]) -> pd.DataFrame:
    """No rows; object columns fit any Arrow type."""
    return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})


# ---------------------------------------------------------------- nearest neighbours

def nearest(queries: DataFrame, bank: DataFrame, k: int, *, by: list[str] | None = None, tag: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """k most similar bank rows per query: columns (*by, qid, bid, sim).

    ``queries`` and ``bank`` carry (*by, id, vec[, tag]). A pair counts only inside one ``by`` group, between different
    ids, and (with ``tag``) between different tags. Groups of one tile are compared whole, small ones packed together so that
    a tile is worth a Python call; larger groups, and a bank of more than ``chunk`` rows without groups, go through
    ``PrunedBank``. Both are exact; similarities are rounded to 13 digits, so that copies tie."""
    by = by or []
    if not by:
        return PrunedBank(bank, k, tag=tag, chunk=chunk).nearest(queries) if bank.limit(chunk + 1).count() > chunk else _compared_whole(queries, bank, k, by, tag, chunk)
    hot = hot_groups(bank, by, chunk * TILE)
    if hot is None:
        return _compared_whole(queries, bank, k, by, tag, chunk)
    hot = cut_lineage(hot)  # at most rows / (chunk * TILE) groups
    cold = _compared_whole(queries.join(hot, by, "left_anti"), bank.join(hot, by, "left_anti"), k, by, tag, chunk)
    return cold.unionByName(PrunedBank(bank.join(hot, by, "left_semi"), k, by=by, tag=tag, chunk=chunk).nearest(queries.join(hot, by, "left_semi")))


def _compared_whole(queries: DataFrame, bank: DataFrame, k: int, by: list[str], tag: str | None, chunk: int) -> DataFrame:
    """All queries of a group with all its bank rows, in tiles."""
    tags = [tag] if tag else []
    size = lambda df, n: df.groupBy(*by).agg(F.count(F.lit(1)).alias(n)) if by else df.agg(F.count(F.lit(1)).alias(n))
    if by:
        sizes = size(queries, "_nq").join(size(bank, "_nb"), by)
        q, b = queries.join(sizes, by), bank.join(sizes, by)
        total = bank.count()
        pack = F.pmod(F.xxhash64(*by), F.lit(max(1, math.ceil(total / chunk))))
    else:
        nq, nb = queries.count(), bank.count()
        q = queries.withColumns({"_nq": F.lit(nq), "_nb": F.lit(nb)})
        b = bank.withColumns({"_nq": F.lit(nq), "_nb": F.lit(nb)})
        pack = F.lit(0).cast("long")
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / (chunk * TILE))).cast("long")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), parts(n) - 1))
    fresh = [F.col(c).alias(c) for c in (*by, "id", "vec", *tags)]  # both sides may come from one table
    q = q.select(*fresh, pack.alias("_g"), F.pmod(F.xxhash64("id"), parts("_nq")).alias("_qc"), spread("_nb").alias("_bc"))
    b = b.select(*fresh, pack.alias("_g"), F.pmod(F.xxhash64("id"), parts("_nb")).alias("_bc"), spread("_nq").alias("_qc"))
    key = ["_g", "_qc", "_bc"]
    types = dict(queries.dtypes)
    schema = ", ".join([*[f"{c} {types[c]}" for c in by], f"qid {types['id']}", f"bid {dict(bank.dtypes)['id']}", "sim double"])

    tiles = q.groupBy(*key).cogroup(b.groupBy(*key)).applyInPandas(_top_tile(by, tags, k, chunk), schema)
    return first_k(tiles, [*by, "qid"], [F.desc("sim"), F.col("bid")], k)


def _first_k(at: np.ndarray, sim: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best finds per row ``at``: largest similarity, then smallest id."""
    order = np.lexsort((other, -sim, at))
    row = at[order]
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
    rank = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
    return order[rank < k]


class _Finds:
    """The k best bank rows of each of some queries, fed with one matrix of similarities after the other.

    A query's k-th find of any matrix bounds what can still matter, so of later matrices only few entries are looked at."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k, self.parts = floor, k, []

    def add(self, rows: np.ndarray, sim: np.ndarray, ids: np.ndarray, asked=None) -> None:
        """``asked(at, c)`` tells which entries count; others may still bound them."""
        k, n = self.k, sim.shape[1]
        open_ = np.flatnonzero(np.isneginf(self.floor[rows]))
        if len(open_) and n >= k:
            self.floor[rows[open_]] = np.partition(sim[open_], n - k, axis=1)[:, n - k]
        hit = sim >= (self.floor[rows] - 1e-12)[:, None]
        at, c = np.nonzero(hit)
        v = sim[at, c]
        fine = ~np.isneginf(v) if asked is None else ~np.isneginf(v) & asked(at, c)
        at, c, v = at[fine], c[fine], np.round(v[fine], 13)
        if len(at) > 2 * k * len(rows):
            best = _first_k(at, v, ids[c], k)
            at, c, v = at[best], c[best], v[best]
        if len(at):
            self.parts.append((rows[at], ids[c], v))

    def table(self, qid: np.ndarray) -> pd.DataFrame:
        if not self.parts:
            return _empty(["qid", "bid", "sim"])
        at, other, v = (np.concatenate(x) for x in zip(*self.parts))
        best = _first_k(at, v, other, self.k)
        return pd.DataFrame({"qid": qid[at[best]], "bid": other[best], "sim": v[best]})


def _similar(a: dict, rows: np.ndarray, c: dict, cols) -> np.ndarray:
    """Similarities of some queries and bank rows; -inf where a pair does not count."""
    sim = a["u"][rows] @ c["u"][cols].T
    sim[a["id"][rows][:, None] == c["id"][cols][None, :]] = -np.inf
    if "tag" in a:
        sim[a["tag"][rows][:, None] == c["tag"][cols][None, :]] = -np.inf
    return sim


def _sides(left: pd.DataFrame, right: pd.DataFrame, tags: list[str]) -> tuple[dict, dict]:
    """Ids, unit vectors and tags (as numbers) of both sides."""
    a, c = ({"id": d["id"].to_numpy(), "u": _unit(_matrix(d["vec"]))} for d in (left, right))
    if tags:
        codes = pd.factorize(pd.concat([left[tags[0]], right[tags[0]]], ignore_index=True))[0]
        a["tag"], c["tag"] = codes[: len(left)], np.where(codes[len(left) :] < 0, -2, codes[len(left) :])
    return a, c


def _top_tile(by: list[str], tags: list[str], k: int, chunk: int):
    """Of a tile's rows on either side: the k most similar per query, ``chunk`` by ``chunk`` rows at a time."""

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        groups = right.groupby(by, sort=False).indices if by else {None: np.arange(len(right))}
        lefts = left.groupby(by, sort=False).indices if by else {None: np.arange(len(left))}
        for g, li in lefts.items():
            ri = groups.get(g)
            if ri is None or not len(li) or not len(ri):
                continue
            a, c = _sides(left.iloc[li], right.iloc[ri], tags)
            for s in range(0, len(li), chunk):
                rows = np.arange(s, min(s + chunk, len(li)))
                finds = _Finds(np.full(len(li), -np.inf), k)
                for h in range(0, len(ri), chunk):
                    cols = slice(h, h + chunk)
                    finds.add(rows, _similar(a, rows, c, cols), c["id"][cols])
                block = finds.table(a["id"])
                for name, v in zip(by, (g if isinstance(g, tuple) else (g,)) if by else ()):
                    block[name] = v
                out.append(block)
        out = [b for b in out if len(b)]
        names = [*by, "qid", "bid", "sim"]
        return pd.concat(out, ignore_index=True)[names] if out else _empty(names)

    return tile


def _walked(m: np.ndarray) -> np.ndarray:
    """Unit vectors in an order in which neighbours follow each other: always on to the nearest one left."""
    left, at, order = np.ones(len(m), bool), 0, []
    for _ in range(len(m)):
        order.append(at)
        left[at] = False
        at = int(np.where(left, m @ m[at], -np.inf).argmax())
    return m[order]


class PrunedBank:
    """Exact nearest neighbours that visit only those cells of the bank that can hold one.

    About 4 sqrt(rows) bank vectors serve as centres; a bank row lies in the cell of its nearest centre, and a cell knows its
    radius (the largest angle to the centre). Angles obey the triangle inequality, so no row of a cell is nearer to a query
    than the angle to the centre less the radius. A query first searches its nearest cells, until they hold twice the rows
    it asks for; its k-th find is the bound, and a second join visits those other cells that can beat or equal it. What is
    compared follows how clustered the bank is: of vectors without any structure every cell is visited.

    Cells are kept per ``by`` group. Neighbouring cells share a pack of about ``chunk * TILE`` rows, and a query goes once to
    each pack with one bit per cell that it visits there: what is shuffled is queries x packs, however many cells are
    visited. A crowded pack is cut by rows into several tiles. At most ``MOST_CENTRES`` centres go to the tasks."""

    MOST_CENTRES = 1024
    SLACK = 1e-7  # more than arccos loses near 1

    def __init__(self, bank: DataFrame, k: int, *, by: list[str] | None = None, tag: str | None = None, chunk: int = CHUNK):
        self.k, self.by, self.tags, self.chunk = k, by or [], [tag] if tag else [], chunk
        types = dict(bank.dtypes)
        count = min(self.MOST_CENTRES, 4 * math.isqrt(bank.count()) + 1)
        pick = bank.orderBy(F.xxhash64("id"), "id").limit(count).select("vec").collect()
        self.centres = centres = _walked(_unit(np.array([r["vec"] for r in pick], dtype=np.float64))) if pick else np.ones((1, 1))
        carried = [*self.by, "id", "vec", *self.tags]
        self.types = {c: types[c] for c in carried}

        def place(batches):
            for pdf in batches:
                if len(pdf):
                    ang = _angles(pdf["vec"], centres)
                    cell = ang.argmin(1)
                    yield pdf.assign(_cell=cell.astype(np.int32), _ang=ang[np.arange(len(pdf)), cell])

        placed = bank.select(*carried).mapInPandas(place, ", ".join([*[f"{c} {t}" for c, t in self.types.items()], "_cell int", "_ang double"]))
        self.placed = cut_lineage(placed)
        cells = self.placed.groupBy(*self.by, "_cell").agg(F.count(F.lit(1)).alias("_n"), F.max("_ang").alias("_r"))
        before = F.sum("_n").over(Window.partitionBy(*self.by).orderBy("_cell")) - F.col("_n")  # at most MOST_CENTRES lines a group
        cells = cells.withColumn("_pack", F.floor(before / (chunk * TILE)).cast("int"))
        at = F.row_number().over(Window.partitionBy(*self.by, "_pack").orderBy("_cell")) - 1
        self.cells = cut_lineage(cells.withColumn("_at", at))
        known = F.array_sort(F.collect_list(F.struct("_cell", "_r", "_n", "_pack"))).alias("_known")
        self.known = self.cells.groupBy(*self.by).agg(known).select(*self.by, *[F.col(f"_known.{c}").alias(f"_k{c}") for c in ("_cell", "_r", "_n", "_pack")])

    def _visits(self, queries: DataFrame, second: bool) -> DataFrame:
        """Queries once per pack to visit, with a bit per cell of it; in the second round (with ``_bound``) without the cells
        of the first."""
        centres, k, by, slack = self.centres, self.k, self.by, self.SLACK
        arrays = ["_k_cell", "_k_r", "_k_n", "_k_pack"]
        keep = [*self.types, "_bound"]
        rows = (queries if second else queries.withColumn("_bound", F.lit(None).cast("double"))).select(*keep)
        names = [*keep, "_pack", "_bits"]
        schema = ", ".join([*[f"{c} {t}" for c, t in self.types.items()], "_bound double, _pack int, _bits binary"])

        def choose(pdf: pd.DataFrame, cells, radius, n, pack):
            ang = _angles(pdf["vec"], centres[cells.astype(np.int64)])
            order = np.argsort(ang, axis=1, kind="stable")
            held = np.cumsum(n[order], axis=1) - n[order]
            want = np.zeros(ang.shape, bool)
            np.put_along_axis(want, order, held < 2 * k + 1, axis=1)
            if second:
                bound = np.arccos(np.clip(pdf["_bound"].fillna(-1.0).to_numpy(), -1, 1))
                want = ~want & (ang - radius[None, :] <= bound[:, None] + slack)
            for p in np.unique(pack):
                own = want[:, pack == p]
                at = np.flatnonzero(own.any(1))
                if len(at):
                    yield pdf.iloc[at].assign(_pack=np.int32(p), _bits=[b.tobytes() for b in np.packbits(own[at], axis=1)])[names]

        def blocks(pdf: pd.DataFrame, known):
            for s in range(0, len(pdf), 1024):
                yield from choose(pdf.iloc[s : s + 1024], *known)

        if not by:  # one line for all queries
            line = self.known.first()
            whole = [np.array(line[c]) for c in arrays] if line and line[arrays[0]] else None

            def run(batches):
                for pdf in batches:
                    if whole is not None:
                        yield from blocks(pdf, whole)

            return rows.mapInPandas(run, schema)

        def of_group(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = list(blocks(left[keep], [np.asarray(right[c].iloc[0]) for c in arrays])) if len(left) and len(right) else []
            return pd.concat(out, ignore_index=True) if out else _empty(names)

        # what is known of a group goes once to each part of its queries, not to every row
        sizes = cut_lineage(rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / self.chunk).cast("long").alias("_np")))
        rows = attach(rows, sizes, by, hot_groups(rows, by)).withColumn("_p", F.pmod(F.xxhash64("id"), F.col("_np"))).drop("_np")
        told = self.known.join(sizes, by).withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_np") - 1))).drop("_np")
        return rows.groupBy(*by, "_p").cogroup(told.groupBy(*by, "_p")).applyInPandas(of_group, schema)

    def _searched(self, visits: DataFrame) -> DataFrame:
        key = [*self.by, "_pack"]
        packs = self.cells.groupBy(*key).agg(F.sum("_n").alias("_n"))
        sizes = packs.join(visits.groupBy(*key).agg(F.count(F.lit(1)).alias("_m")), key)
        parts = lambda n: F.ceil(F.col(n) / (self.chunk * TILE)).cast("long")
        tiles = cut_lineage(sizes.select(*key, parts("_n").alias("_nh"), parts("_m").alias("_np")))
        part = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.col(n))
        copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        fresh = lambda d: d.select([F.col(c).alias(c) for c in d.columns])
        # a line per cell and a line per pack are few beside the rows; a hot one meets its rows by broadcast
        lines = fresh(self.cells.select(*self.by, "_cell", "_at", "_pack").join(tiles, key))
        home = fresh(attach(fresh(self.placed), lines, [*self.by, "_cell"], hot_groups(self.placed, [*self.by, "_cell"])).select(*self.types, "_pack", "_at", part("_nh", 1).alias("_h"), copies("_np").alias("_p")))
        probe = fresh(attach(fresh(visits), fresh(tiles), key, hot_groups(visits, key)).select(*self.types, "_bound", "_bits", "_pack", part("_np", 2).alias("_p"), copies("_nh").alias("_h")))
        schema = ", ".join([*[f"{c} {self.types[c]}" for c in self.by], f"qid {self.types['id']}", f"bid {self.types['id']}", "sim double"])
        at = [*key, "_h", "_p"]
        return probe.groupBy(*at).cogroup(home.groupBy(*at)).applyInPandas(_pack_tile(self.by, self.tags, self.k, self.chunk), schema)

    def nearest(self, queries: DataFrame) -> DataFrame:
        queries = queries.select(*self.types)
        best = [*self.by, "qid"]
        self.first = cut_lineage(self._visits(queries, False))
        found = cut_lineage(first_k(self._searched(self.first), best, [F.desc("sim"), F.col("bid")], self.k))
        bound = found.groupBy(*best).agg(F.when(F.count(F.lit(1)) >= self.k, F.min("sim")).alias("_bound"))
        asked = queries.join(bound.withColumnRenamed("qid", "id"), [*self.by, "id"], "left")
        self.second = cut_lineage(self._visits(asked, True))
        return first_k(found.unionByName(self._searched(self.second)), best, [F.desc("sim"), F.col("bid")], self.k)

    def compared(self) -> int:
        """Pairs that the last search had to compare (a block of queries that visits most of a pack compares all of it)."""
        bit = F.substring("_bits", (F.floor(F.col("_at") / 8) + 1).cast("int"), F.lit(1))
        on = F.conv(F.hex(bit), 16, 10).cast("int").bitwiseAND(F.pow(F.lit(2), 7 - F.col("_at") % 8).cast("int")) > 0
        key = [*self.by, "_pack"]
        visits = self.first.select(*key, "_bits").unionByName(self.second.select(*key, "_bits"))
        return visits.join(self.cells, key).where(on).agg(F.sum("_n")).first()[0] or 0


def _pack_tile(by: list[str], tags: list[str], k: int, chunk: int):
    """The k most similar rows per query of the cells that its bits name."""

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [*by, "qid", "bid", "sim"]
        if not len(left) or not len(right):
            return _empty(names)
        right = right.sort_values("_at", kind="stable")
        a, c = _sides(left, right, tags)
        cell, first, size = np.unique(right["_at"].to_numpy(), return_index=True, return_counts=True)
        of = np.repeat(np.arange(len(cell)), size)
        bits = np.unpackbits(np.frombuffer(b"".join(left["_bits"]), np.uint8).reshape(len(left), -1), axis=1)
        floor = left["_bound"].astype("float64").fillna(-np.inf).to_numpy(copy=True)
        out = []
        for s in range(0, len(left), chunk):
            rows = np.arange(s, min(s + chunk, len(left)))
            own = bits[s : s + chunk][:, cell].astype(bool)
            finds = _Finds(floor, k)
            if (own * size).sum() > 0.3 * len(rows) * len(right):  # one matrix; what the first round has seen is left out
                for h in range(0, len(right), chunk):
                    cols = slice(h, h + chunk)
                    finds.add(rows, _similar(a, rows, c, cols), c["id"][cols], lambda at, j: own[at, of[h + j]])
            else:
                for j in np.flatnonzero(own.any(0)):
                    at = rows[own[:, j]]
                    for h in range(first[j], first[j] + size[j], chunk):
                        cols = slice(h, min(h + chunk, first[j] + size[j]))
                        finds.add(at, _similar(a, at, c, cols), c["id"][cols])
            block = finds.table(a["id"])
            if len(block):
                out.append(block)
        found = pd.concat(out, ignore_index=True) if out else _empty(["qid", "bid", "sim"])
        for name in by:
            found[name] = left[name].iloc[0]
        return found[names]

    return tile


def _angles(vecs: pd.Series, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(_matrix(vecs)) @ centres.T, -1, 1))


def knn_distance(queries: DataFrame, bank: DataFrame, k: int, *, by: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """Mean cosine distance to the k nearest bank rows (fewer where a group holds fewer)."""
    near = nearest(queries, bank, k, by=by, chunk=chunk)
    return near.groupBy(*(by or []), "qid").agg(F.avg(1 - F.col("sim")).alias("distance"))


# ---------------------------------------------------------------- similarity over a threshold

class CosineCells:
    """Vectors (id, vec) placed so that all partners over a cosine threshold meet; exact.

    Partners lie within sqrt(2 - 2 cos) of each other on the unit sphere, hence along any direction too. A sample of fixed size
    gives a few directions of large spread and a tree of cuts along them; its leaves are the cells, and a cell knows the box
    that all its rows lie in. A row's home is one cell, its partners live in the cells whose boxes are within reach. A leaf is
    cut on only while it is wider than twice the reach, so at a threshold too loose for that all rows share one cell and every
    pair is compared.

    Neighbouring cells share a pack, and a probe travels once to each pack that holds a cell within its reach, however many
    cells it visits there; a crowded pack is cut by rows into tiles. At most ``MOST_CELLS`` boxes go to the tasks."""

    MOST_CELLS = 4096
    SAMPLE = 8192
    SLACK = 1e-5  # more than coordinates lose in single precision
    SIDE_BYTES = 16 << 20  # of the home rows' vectors of a tile; of probes it holds up to PROBES times as many
    PROBES = 4
    FEWEST = 16  # tiles along a side, as long as they hold chunk * TILE rows

    def __init__(self, df: DataFrame, min_cos: float, pivots: int = 16, chunk: int = CHUNK):
        self.min_cos, self.chunk = min_cos, chunk
        self.id_type = dict(df.dtypes)["id"]
        reach = math.sqrt(max(0.0, 2 - 2 * min_cos)) + self.SLACK
        n = df.count()
        pick = df.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // self.SAMPLE))) == 0).select("vec").limit(2 * self.SAMPLE).collect() or df.select("vec").limit(1).collect()
        u = _unit(np.array([r["vec"] for r in pick], dtype=np.float64)) if pick else np.ones((1, 1))
        axes = np.linalg.eigh(np.cov(u, rowvar=False, bias=True).reshape(u.shape[1], -1))[1][:, ::-1][:, :pivots]  # of largest spread
        most = max(chunk, math.ceil(n / self.MOST_CELLS)) * len(u) / max(1, n)
        cuts = _cuts(u @ axes, most, 2 * reach, self.MOST_CELLS)
        k = axes.shape[1]

        def place(batches):
            for batch in batches:
                m = np.ascontiguousarray(_flat(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in m], pa.binary()), pa.array(_leaves(_unit(m) @ axes, cuts))], ["id", "vec", "cell"])

        # written once, read by every pass
        self.homes = cut_lineage(df.select("id", "vec").mapInArrow(place, f"id {self.id_type}, vec binary, cell int"))

        def boxes(batches):
            for pdf in batches:
                if len(pdf):
                    at = _unit(_doubles(pdf["vec"])) @ axes
                    yield pd.DataFrame(at, columns=names).assign(cell=pdf["cell"].to_numpy()).groupby("cell").agg(**{"n": (names[0], "size")}, **{f"{f}{c}": (c, f) for c in names for f in ("min", "max")}).reset_index()

        names = [f"c{j}" for j in range(k)]
        ends = [f"{f}{c}" for c in names for f in ("min", "max")]
        seen = self.homes.select("vec", "cell").mapInPandas(boxes, ", ".join(["cell int, n long", *[f"{e} double" for e in ends]]))
        table = seen.groupBy("cell").agg(F.sum("n").alias("n"), *[(F.min if e.startswith("min") else F.max)(e).alias(e) for e in ends]).orderBy("cell").collect()  # at most MOST_CELLS
        low, high = (np.array([[r[f"{f}{c}"] for c in names] for r in table], dtype=np.float32).reshape(-1, k) for f in ("min", "max"))
        number, held = np.array([r["cell"] for r in table], np.int64), np.array([r["n"] for r in table], np.int64)
        fits = max(chunk, self.SIDE_BYTES // (8 * len(axes)))
        self.side, probes = (min(times * fits, max(chunk * TILE, n // self.FEWEST)) for times in (1, self.PROBES))
        pack = (np.cumsum(held) - held) // self.side
        pack = np.unique(pack, return_inverse=True)[1]
        first = np.flatnonzero(np.r_[True, pack[1:] != pack[:-1]]) if len(pack) else np.zeros(0, int)

        def within(m: np.ndarray, cells: np.ndarray) -> np.ndarray:
            """Which of the cells are within reach of which rows."""
            at = (_unit(m) @ axes).astype(np.float32)
            out = np.empty((len(m), len(cells)), bool)
            for s in range(0, len(m), 256):
                far = np.zeros((len(at[s : s + 256]), len(cells)), np.float32)
                for j in range(k):
                    c = at[s : s + 256, j, None]
                    gap = np.maximum(low[cells, j] - c, c - high[cells, j])
                    far += np.square(np.maximum(gap, 0, out=gap), out=gap)
                out[s : s + 256] = far <= reach * reach
            return out

        def count(batches):
            for pdf in batches:
                if len(pdf) and len(number):
                    near = within(_doubles(pdf["vec"]), np.arange(len(number)))
                    packs = np.logical_or.reduceat(near, first, axis=1)
                    yield pd.DataFrame({"of_pack": np.arange(len(number) + len(first)) >= len(number), "at": [*range(len(number)), *range(len(first))], "n": np.r_[near.sum(0), packs.sum(0)]})

        told = self.homes.select("vec").mapInPandas(count, "of_pack boolean, at int, n long").groupBy("of_pack", "at").agg(F.sum("n").alias("n")).collect()  # two lines a cell at most
        asked = {(r["of_pack"], r["at"]): r["n"] for r in told}
        lines = [(int(c), int(h), int(asked.get((False, i), 0))) for i, (c, h) in enumerate(zip(number, held))]
        self.cells = df.sparkSession.createDataFrame(lines, "cell int, n_home long, n_probe long")
        parts = lambda rows, side: max(1, math.ceil(rows / side))
        at_home, asking = [int(held[pack == p].sum()) for p in range(len(first))], [asked.get((True, p), 0) for p in range(len(first))]
        self.home_parts, self.probe_parts = [parts(h, self.side) for h in at_home], [parts(m, probes) for m in asking]
        self.travelled = sum(h * m_p + m * h_p for h, m, h_p, m_p in zip(at_home, asking, self.home_parts, self.probe_parts))  # rows of one pass over all
        self.pack_of = dict(zip(number.tolist(), pack.tolist()))
        self._within, self._first, self._of = within, first, {c: i for i, c in enumerate(number.tolist())}

    def compared(self) -> int:
        """Pairs that one pass over all rows compares."""
        return self.cells.agg(F.sum(F.col("n_home") * F.col("n_probe"))).first()[0] or 0

    def run(self, reducer, schema: str, homes: DataFrame | None = None, probes: DataFrame | None = None, merge=None) -> DataFrame:
        """``reducer(home rows, probe rows, similarity matrix)`` on every block of ``chunk`` by ``chunk`` rows that meet, home rows
        in the order of their ids. ``homes`` and ``probes`` (id, payload...) choose the rows that take part and what they
        carry; a home row is in one cell, a probe in all it may visit. ``merge`` joins the results of a tile's blocks."""
        chunk, within, first, of = self.chunk, self._within, self._first, self._of
        fresh = lambda d: d.select([F.col(c).alias(c) for c in d.columns])  # both sides come from one table
        home = fresh(unsent(self.homes).join(self.homes.select("id") if homes is None else homes, "id"))
        probe = fresh(unsent(self.homes.select("id", "vec")).join(self.homes.select("id") if probes is None else probes, "id"))
        kinds = ", ".join(f"{c} {t}" for c, t in probe.dtypes)

        def visits(batches):
            for batch in batches:
                m, everything = _doubles(batch.column("vec").to_pylist()), np.arange(len(of))
                packs = np.logical_or.reduceat(within(m, everything), first, axis=1) if len(m) else np.zeros((0, len(first)), bool)
                row, pack = np.nonzero(packs)
                took = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*took.columns, pa.array(pack.astype(np.int32))], [*batch.schema.names, "_g"])

        number = lambda values, at: F.get(F.lit(values or [0]), at)
        part = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), F.col("id")), n)
        copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - F.lit(1).cast("long")))
        packs = [self.pack_of.get(c, 0) for c in range(max(of, default=0) + 1)]
        home = home.withColumn("_g", number(packs, F.col("cell")))
        probe = probe.mapInArrow(visits, f"{kinds}, _g int")
        n_h, n_p = number(self.home_parts, F.col("_g")), number(self.probe_parts, F.col("_g"))
        home = home.select("*", part(n_h, 1).alias("_h"), copies(n_p).alias("_p"))
        probe = probe.select("*", part(n_p, 2).alias("_p"), copies(n_h).alias("_h"))
        names = [f.strip().split(" ")[0] for f in schema.split(",")]

        def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return _empty(names)
            left = left.sort_values("id", kind="stable")
            groups = left.groupby("cell", sort=False).indices
            b = _doubles(right["vec"])
            met = within(b, np.array([of[c] for c in groups]))
            a, b, out = _unit(_doubles(left["vec"])), _unit(b), []
            left, right = left.drop(columns="vec"), right.drop(columns="vec")
            for c, x in enumerate(groups.values()):
                y = np.flatnonzero(met[:, c])
                for s in range(0, len(x), chunk):
                    for t in range(0, len(y), chunk):
                        i, j = x[s : s + chunk], y[t : t + chunk]
                        found = reducer(left.iloc[i], right.iloc[j], a[i] @ b[j].T)
                        if len(found):
                            out.append(found)
                if merge is not None and len(out) > TILE:
                    out = [merge(pd.concat(out, ignore_index=True))]
            if not out:
                return _empty(names)
            out = pd.concat(out, ignore_index=True)
            return merge(out)[names] if merge is not None else out[names]

        key = ["_g", "_h", "_p"]
        return home.groupBy(*key).cogroup(probe.groupBy(*key)).applyInPandas(tile, schema)


def _flat(column) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _doubles(values) -> np.ndarray:
    """Vectors that travel as bytes, as a matrix."""
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1) if len(values) else np.zeros((0, 1))


def _cuts(at: np.ndarray, most: float, least_width: float, leaves: int) -> np.ndarray:
    """A tree of cuts through points, as rows (axis or -1, cut, lower child or number of the leaf, upper child): the largest
    leaf is halved next, along the axis of its largest spread, unless it holds ``most`` points or is no wider than
    ``least_width``. Leaves are numbered so that neighbours follow each other."""
    tree, heap, n = [[-1, 0.0, 0, 0]], [(-len(at), 0, np.arange(len(at)))], 1
    while heap and n < leaves:
        size, node, rows = heapq.heappop(heap)
        own = at[rows]
        axis = int(own.std(0).argmax()) if len(own) else 0
        if -size <= most or np.ptp(own[:, axis]) <= least_width:
            continue
        cut = float(np.median(own[:, axis]))
        low = own[:, axis] <= cut
        if low.all():
            low = own[:, axis] < cut
            cut = float(own[low, axis].max())
        tree[node] = [axis, cut, len(tree), len(tree) + 1]
        for half in (rows[low], rows[~low]):
            heapq.heappush(heap, (-len(half), len(tree), half))
            tree.append([-1, 0.0, 0, 0])
        n += 1
    number, stack = 0, [0]
    while stack:
        node = stack.pop()
        if tree[node][0] < 0:
            tree[node][2], number = number, number + 1
        else:
            stack += [int(tree[node][3]), int(tree[node][2])]
    return np.array(tree, dtype=np.float64)


def _leaves(at: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """The leaf's number of every point."""
    axis, low, high = (tree[:, c].astype(np.int32) for c in (0, 2, 3))
    node = np.zeros(len(at), np.int32)
    while len(at) and (inner := axis[node] >= 0).any():
        go = at[np.arange(len(at)), np.maximum(axis[node], 0)] <= tree[node, 1]
        node = np.where(inner, np.where(go, low[node], high[node]), node)
    return low[node]


def centred(df: DataFrame, vec: str, out: str = "vec", unit: bool = True) -> DataFrame:
    """Every vector less the mean of its own components, at unit length if wanted (a constant vector becomes zero)."""
    mean = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x) / F.size(vec)
    less = df.withColumn("_m", mean).withColumn("_c", F.transform(vec, lambda x: x - F.col("_m"))).drop("_m")
    if not unit:
        return less.withColumn(out, F.col("_c")).drop("_c")
    less = less.withColumn("_l", F.sqrt(F.aggregate("_c", F.lit(0.0), lambda a, x: a + x * x)))
    scaled = F.transform("_c", lambda x: F.when(F.col("_l") > 0, x / F.col("_l")).otherwise(0.0))
    return less.withColumn(out, scaled).drop("_c", "_l")


def vector_key(vec) -> Column:
    return F.md5(F.to_json(F.struct(vec if isinstance(vec, Column) else F.col(vec))))


def near_dup_partners(df: DataFrame, key: str, vec: str, group: str, min_cos: float, **kw) -> DataFrame:
    """Per distinct vector: how many similar vectors of other groups there are, the first of them, the best cosine.

    A vector is named by its first row. Two vectors found only in one and the same group do not count as partners.
    One line per vector, never a list of pairs; copies stand behind their vector as a count."""
    v = df.withColumn("_k", vector_key(vec)).groupBy("_k").agg(
        F.min(key).alias("id"), F.first(vec).alias("vec"), F.count(F.lit(1)).alias("copies"), F.min(group).alias("g0"), F.max(group).alias("g1"))
    v = cut_lineage(v)  # read by the cells, for the groups and for the lines at the end
    cells = CosineCells(v.select("id", "vec"), min_cos, **kw)
    tags = v.select("id", "g0", "g1")

    def count(left, right, sim):
        ida, idb = left["id"].to_numpy(), right["id"].to_numpy()
        x, y = np.nonzero(sim >= min_cos)
        ga, gb = _one_group(left, right)
        ok = (ida[x] != idb[y]) & (ga[x] != gb[y])
        x, y = x[ok], y[ok]  # in the order of the ids on the left
        cols, at = np.unique(y, return_index=True)
        n = np.bincount(y, minlength=len(idb))[cols]
        best = np.full(len(idb), -2.0)
        np.maximum.at(best, y, sim[x, y])
        return pd.DataFrame({"id": idb[cols], "n": n, "first": ida[x[at]], "cos": best[cols]})

    def added(found):
        return found.groupby("id", as_index=False, sort=False).agg({"n": "sum", "first": "min", "cos": "max"})

    t = cells.id_type
    found = cells.run(count, f"id {t}, n long, first {t}, cos double", tags, tags, added)
    found = found.groupBy("id").agg(F.sum("n").alias("partners"), F.min("first").alias("first_partner"), F.max("cos").alias("best_cos"))
    out = v.select("id", "copies", (F.col("g0") != F.col("g1")).alias("spans_groups")).join(found, "id", "left")
    return out.where("partners is not null or spans_groups").withColumn("partners", F.coalesce("partners", F.lit(0)))


def _one_group(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A number per row of either side, equal for two rows that lie in one and the same group only."""
    codes = pd.factorize(pd.concat([left["g0"], right["g0"], left["g1"], right["g1"]], ignore_index=True), use_na_sentinel=False)[0]
    low, high = codes[: len(codes) // 2], codes[len(codes) // 2 :]
    own = low == high
    n = len(left)
    return np.where(own[:n], low[:n], -1), np.where(own[n:], low[n:], -2)


def near_dup_keep(df: DataFrame, key: str, vec: str, group: str, min_cos: float, exempt: Column | None = None, pack: int = PACK_ROWS, **kw) -> DataFrame:
    """Greedy near-duplicate removal in key order: a row is dropped when an earlier kept row of another group is similar.

    Rows that are ``exempt`` (a source whose items are alike by design) take no part: they stay and drop nobody. So do
    null and zero vectors, which have no direction (``min_cos`` is above 0).

    Rows with one vector and one group share their fate, so the work is on (vector, group) entries. One similarity pass
    returns links enough to connect what is similar, not its pairs. What no link touches is decided at once. Components of
    at most ``pack`` entries are packed into tasks, each of which walks its entries in order and compares them with the
    kept ones only. Of larger components the first ``pack`` entries are walked in one task, those they kept knock out
    later entries in one distributed pass, and the rest goes on: every round settles ``pack`` entries and all that
    resemble what was kept of them, whatever the length of chains."""
    free = ~F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))
    if exempt is not None:
        free = free | F.coalesce(exempt, F.lit(False))
    apart = df.where(free).withColumn("keep", F.lit(True))
    df = df.where(~free)
    rows = df.withColumn("_k", vector_key(vec))
    nodes = cut_lineage(rows.groupBy("_k").agg(F.min(key).alias("id"), F.first(vec).alias("vec")))
    cells = CosineCells(nodes.select("id", "vec"), min_cos, **kw)
    entries = rows.groupBy("_k", group).agg(F.min(key).alias("seq")).join(nodes.select("_k", F.col("id").alias("node")), "_k")
    t, g = cells.id_type, dict(df.dtypes)[group]

    def forest(left, right, sim):
        x, y = np.nonzero(sim >= min_cos)
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        of = np.full(len(right), len(left))
        own = np.arange(len(left))
        while True:  # the smallest row on the left that a row is linked to, passed on until nothing changes
            np.minimum.at(of, y, own[x])
            now = own.copy()
            np.minimum.at(now, x, of[y])
            if (now == own).all():
                break
            own = now
        linked = of < len(left)
        from_, to = np.concatenate([a, b[linked]]), np.concatenate([a[own], a[of[linked]]])
        return pd.DataFrame({"a": from_[from_ != to], "b": to[from_ != to]})

    def joined(links):
        return _roots(links.rename(columns={"a": "u", "b": "v"})).rename(columns={"u": "a", "v": "b"})

    roots = connected(cells.run(forest, f"a {t}, b {t}", merge=joined))
    entries = entries.join(roots, "node", "left").select("_k", "node", F.col(group).alias("grp"), "seq", F.coalesce("root", "node").alias("root"))
    entries = cut_lineage(entries)
    size = entries.groupBy("root").agg(F.count(F.lit(1)).alias("_n"))
    large = cut_lineage(size.where(F.col("_n") > pack).select("root"))  # at most entries / pack
    alone = size.where("_n = 1").select("root")
    fate = entries.join(alone, "root", "left_semi").select("_k", "grp", F.lit(True).alias("keep"))
    some = entries.join(alone, "root", "left_anti").join(F.broadcast(large), "root", "left_anti")
    some = some.join(unsent(nodes.select("_k", "vec")), "_k")
    walk = _walk(min_cos)
    schema = f"_k string, grp {g}, keep boolean"
    packs = max(1, math.ceil(entries.count() / pack))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([walk(own) for _, own in pdf.groupby("root", sort=False)], ignore_index=True)

    fate = fate.unionByName(some.groupBy(F.pmod(F.xxhash64("root"), F.lit(packs))).applyInPandas(packed, schema))
    if not large.isEmpty():
        fate = fate.unionByName(_settled_in_rounds(entries.join(F.broadcast(large), "root", "left_semi"), nodes, cells, walk, schema, g, min_cos, pack))
    fate = cut_lineage(fate).withColumnRenamed("grp", group)
    return attach(unsent(rows), fate, ["_k", group], hot_groups(rows, ["_k", group])).drop("_k").select(*apart.columns).unionByName(apart)


def _walk(min_cos: float, block: int = 256):
    """Greedy pass over entries (_k, grp, seq, vec) in the order of ``seq``."""
    apart = lambda a, b: (a != b) & (a >= 0) & (b >= 0)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        u, grp = _unit(_matrix(pdf["vec"])), pd.factorize(pdf["grp"])[0]  # a null group, -1, is apart from none
        node, keep = pd.factorize(pdf["_k"])[0], np.zeros(len(pdf), bool)
        for s in range(0, len(pdf), block):
            e = min(s + block, len(pdf))
            kept = np.flatnonzero(keep[:s])
            lost = np.zeros(e - s, bool)
            for c in range(0, len(kept), 8192):
                had = kept[c : c + 8192]
                near = (u[s:e] @ u[had].T >= min_cos) | (node[s:e, None] == node[None, had])
                lost |= (near & apart(grp[s:e, None], grp[None, had])).any(1)
            inner = ((u[s:e] @ u[s:e].T >= min_cos) | (node[s:e, None] == node[None, s:e])) & apart(grp[s:e, None], grp[None, s:e])
            for i in range(e - s):
                if not lost[i]:
                    keep[s + i] = True
                    lost[i + 1 :] |= inner[i, i + 1 :]
        return pd.DataFrame({"_k": pdf["_k"].to_numpy(), "grp": pdf["grp"].to_numpy(), "keep": keep})

    return walk


def _settled_in_rounds(entries: DataFrame, nodes: DataFrame, cells: CosineCells, walk, schema: str, g: str, min_cos: float, pack: int) -> DataFrame:
    """Fates of the entries of large components, the first ``pack`` of them a round."""

    def knock(left, right, sim):
        """Of each vector: the smallest and largest group among similar kept entries; two different ones drop all entries."""
        near = (sim >= min_cos) | (left["id"].to_numpy()[:, None] == right["id"].to_numpy()[None, :])
        low, high = left["g_lo"].to_numpy(), left["g_hi"].to_numpy()
        hit = np.flatnonzero(near.any(0))
        return pd.DataFrame({"node": right["id"].to_numpy()[hit], "lo": [low[near[:, c]].min() for c in hit], "hi": [high[near[:, c]].max() for c in hit]})

    def widest(heard):
        return heard.groupby("node", as_index=False, sort=False).agg({"lo": "min", "hi": "max"})

    left, fate = cut_lineage(entries.select("_k", "node", "grp", "seq")), None
    while not left.isEmpty():
        first = cut_lineage(left.orderBy("seq").limit(pack))
        told = first.join(unsent(nodes.select("_k", "vec")), "_k").groupBy().applyInPandas(walk, schema)
        told = cut_lineage(told)
        kept = told.where("keep and grp is not null").join(nodes.select("_k", F.col("id")), "_k").groupBy("id").agg(F.min("grp").alias("g_lo"), F.max("grp").alias("g_hi"))
        rest = left.join(first.select("_k", "grp"), ["_k", "grp"], "left_anti")
        asking = rest.select(F.col("node").alias("id")).distinct()
        heard = cells.run(knock, f"node {cells.id_type}, lo {g}, hi {g}", kept, asking, widest).groupBy("node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        rest = rest.join(heard, "node", "left").withColumn("_out", F.coalesce((F.col("lo") != F.col("grp")) | (F.col("hi") != F.col("grp")), F.lit(False)))
        rest = cut_lineage(rest)
        told = told.unionByName(rest.where("_out").select("_k", "grp", F.lit(False).alias("keep")))
        fate = told if fate is None else fate.unionByName(told)
        left = cut_lineage(rest.where("not _out").select("_k", "node", "grp", "seq"))
    return fate


# ---------------------------------------------------------------- binary hashes

def hamming_partners(df: DataFrame, key: str, bits: str, max_bits: int = 8, bands: int = 4, width: int = 16, hot: int = 4096) -> DataFrame:
    """Per distinct hash: partners that share a band and differ in at most ``max_bits`` places, the first of them and
    the smallest distance.

    Equal hashes are collapsed first and stand behind their hash as a count. Bands that many hashes share are cut into
    salted blocks, so no band is one task; a pair is counted by its first shared band only, and counted where it is
    found, never written out."""
    h = df.groupBy(bits).agg(F.min(key).alias("id"), F.count(F.lit(1)).alias("copies"))
    num = lambda c, i: F.conv(F.substring(c, 1 + i * width, width), 2, 10).cast("long")
    h = h.withColumn("_w", F.array(*[num(bits, i) for i in range(bands)]))
    x = h.select("id", "_w", F.posexplode("_w").alias("band", "val"))
    size = x.groupBy("band", "val").agg(F.count(F.lit(1)).alias("_c"))
    big = size.where(F.col("_c") > hot).select("band", "val")
    x = attach(x, size.where("_c > 1"), ["band", "val"], None if big.isEmpty() else big)
    x = x.withColumn("_s", F.ceil(F.col("_c") / hot).cast("long")).withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_s")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_s") - 1))
    a = x.select("band", "val", F.col("id").alias("a"), F.col("_w").alias("_wa"), F.col("_own").alias("_sa"), other.alias("_sb"))
    b = x.select("band", "val", F.col("id").alias("b"), F.col("_w").alias("_wb"), F.col("_own").alias("_sb"), other.alias("_sa"))
    dist = sum((F.bit_count(F.get("_wa", i).bitwiseXOR(F.get("_wb", i))) for i in range(bands)), F.lit(0))
    earlier = F.lit(False)
    for i in range(bands):
        earlier = earlier | ((F.get("_wa", i) == F.get("_wb", i)) & (F.lit(i) < F.col("band")))
    hit = a.join(b, ["band", "val", "_sa", "_sb"]).where((F.col("a") != F.col("b")) & ~earlier).withColumn("distance", dist).where(F.col("distance") <= max_bits)
    found = hit.groupBy("a").agg(F.count(F.lit(1)).alias("partners"), F.min("b").alias("first_partner"), F.min("distance").cast("int").alias("distance"))
    out = h.select("id", "copies").join(found.withColumnRenamed("a", "id"), "id", "left")
    return out.where("partners is not null or copies > 1").withColumn("partners", F.coalesce("partners", F.lit(0)))
