"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine c or more are at squared distance 2 - 2c or less. Vectors are rotated (a fixed random rotation,
so that no direction is special) and cut into ``BLOCKS`` low-dimensional blocks; of a linked pair some block is at a
squared distance of at most the budget (2 - 2c) * (block's dimensions / all dimensions). Every block is range-joined on
its own: a grid over its first coordinates puts each vector in its own cell and, as a visitor, in those cells that its
radius reaches, so every pair within the budget meets in the cell of either. A pair is a candidate of the first block
whose budget it meets, so it is verified once from either side, exactly: the cosine of the vectors as given, in double
precision.

Two passes share the cells. The first sends a row to its cells with nothing but its block's coordinates (two bytes each)
and keeps the rows that are within the budget of another one; only those travel again, with their vectors, to be verified.
No pairs are written: a task returns each vector's number of links and the few links that connect what it saw. Equal
vectors are compared once. Cells over ``CELL_ROWS`` rows are dealt in tiles, so a dense group never meets in one task.
The grid takes more coordinates the more vectors a label has. Block coordinates are rounded to integers and written once,
which makes a pair's block distances the same numbers wherever it is seen; budgets allow for the rounding.

Vectors that are null, zero or hold null or non-finite components, and those without a label, link with nothing; so
do vectors of different lengths. Rows of one id are rows of their own: they count in each other's links, each has its
own component, and all of them are kept if the component bears their id. Extra columns are ignored; an empty table gives
an empty result."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.scale import attach, hot_groups
from lotwise.llm.shared import components, written

COSINE = 0.98
BLOCKS = 8
GRID = 1 << 14  # coordinates of unit vectors are kept as multiples of 1 / GRID, two bytes each
WIDTH = 4.0  # width of a cell in radii of a block
CELL_ROWS = 16_384  # of a side of a tile, of vectors of up to 64 numbers
TARGET_ROWS = 16_384  # of a cell, when choosing how many coordinates the grid takes: each one more copies a row by half
HOT = 100_000


def usable(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(x, lambda v: v != 0)


def rotation(dims: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _flat(column) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _coordinates(x: np.ndarray) -> np.ndarray:
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    return np.rint(unit @ rotation(x.shape[1]) * GRID).astype("<i2")


def _cuts(dims: int, blocks: int) -> list[tuple[int, int]]:
    edges = [i * dims // min(blocks, dims) for i in range(min(blocks, dims) + 1)]
    return list(zip(edges, edges[1:]))


def _budgets(dims: int, cosine: float, blocks: int) -> list[int]:
    """Squared distances per block, in grid units, with room for rounding every coordinate."""
    out = []
    for lo, hi in _cuts(dims, blocks):
        radius = np.sqrt((2 - 2 * cosine) * (hi - lo) / dims) * GRID + 2 * np.sqrt(hi - lo)
        out.append(int(radius * radius) + 1)
    return out


def _cells(coords: np.ndarray, radius: float, width: float):
    """(row, cell, home) of every cell that a row's radius reaches, over the given coordinates."""
    low, high = np.floor((coords - radius) / width).astype(np.int64), np.floor((coords + radius) / width).astype(np.int64)
    own = np.floor(coords / width).astype(np.int64)
    rows, cells, homes = [], [], []
    for choice in itertools.product((0, 1), repeat=coords.shape[1]):
        pick = np.array(choice, bool)
        valid = ((high > low) | ~pick).all(axis=1)
        at = np.flatnonzero(valid)
        got = np.where(pick, high[at], low[at])
        number = np.zeros(len(at), np.int64)
        for j in range(coords.shape[1]):
            number = number * 128 + (got[:, j] + 64)
        rows.append(at)
        cells.append(number)
        homes.append((got == own[at]).all(axis=1))
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(homes)


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of the links that connect what all links connect."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[y] = x
            kept.append(i)
    return kept


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of two sets of integer points; exact, since every sum stays far below 2^53."""
    left = np.column_stack([-2.0 * a, (a * a).sum(1), np.ones(len(a))])
    return left @ np.column_stack([b, np.ones(len(b)), (b * b).sum(1)]).T


def _blocks(table: pa.Table, tile: int):
    """Home rows and visitors of a tile of a cell, some at a time."""
    role = np.asarray(table.column("role"))
    home, seen = np.flatnonzero(role != 1), np.flatnonzero(role != 2)  # 0: both, 1: visitor only, 2: home only
    for s in range(0, len(home), tile):
        for t in range(0, len(seen), 4 * tile):
            yield home[s : s + tile], seen[t : t + 4 * tile]


def _numbers(column, kind: str) -> np.ndarray:
    """A binary column of equal lengths as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)


def _promising(table: pa.Table, cosine: float, blocks: int, tile: int = 512) -> pa.Table:
    """The rows of a tile that are within their block's budget of another row."""
    budget = _budgets(table.column("dims")[0].as_py(), cosine, blocks)[table.column("block")[0].as_py()]
    uid, near = np.asarray(table.column("uid")), _numbers(table.column("near"), "<i2")
    hit = np.zeros(len(uid), bool)
    for h, v in _blocks(table, tile):
        x, y = np.nonzero(_distances(near[h], near[v]) <= budget)
        x, y = h[x], v[y]
        fresh = uid[x] != uid[y]
        hit[x[fresh]] = True
        hit[y[fresh]] = True
    return table.filter(pa.array(hit))


def _verify(table: pa.Table, cosine: float, blocks: int, tile: int = 512):
    """Links of the home rows of a tile of a cell with all its visitors: (a, b, n) as n links of a, or a link a - b."""
    block = table.column("block")[0].as_py()
    uid, copies = np.asarray(table.column("uid")), np.asarray(table.column("copies"))
    coords = _numbers(table.column("coords"), "<i2")
    short = np.array([len(v) for v in table.column("vec").to_pylist()]) == 4 * coords.shape[1]
    given = np.empty(coords.shape)
    for narrow, kind in ((True, "<f4"), (False, "<f8")):
        if (short == narrow).any():
            given[short == narrow] = _numbers(table.column("vec").filter(pa.array(short == narrow)), kind)
    norms = np.sqrt((given * given).sum(1))
    cuts, budgets = _cuts(coords.shape[1], blocks), _budgets(coords.shape[1], cosine, blocks)
    counts = np.zeros(len(uid), np.int64)
    link_a, link_b = [], []
    lo, hi = cuts[block]
    for h, v in _blocks(table, tile):
        x, y = np.nonzero(_distances(coords[h, lo:hi], coords[v, lo:hi]) <= budgets[block])
        x, y = h[x], v[y]
        fresh = uid[x] != uid[y]
        for k, (a, b) in enumerate(cuts[:block]):  # a candidate of an earlier block is that block's
            gap = coords[x[fresh], a:b] - coords[y[fresh], a:b]
            fresh[np.flatnonzero(fresh)[(gap * gap).sum(1) <= budgets[k]]] = False
        x, y = x[fresh], y[fresh]
        if not len(x):
            continue
        good = np.concatenate([(given[x[i : i + 65536]] * given[y[i : i + 65536]]).sum(1) / (norms[x[i : i + 65536]] * norms[y[i : i + 65536]]) >= cosine for i in range(0, len(x), 65536)])
        x, y = x[good], y[good]
        np.add.at(counts, x, copies[y])
        kept = _forest(uid[x], uid[y])
        link_a.append(uid[x[kept]])
        link_b.append(uid[y[kept]])
    a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (link_a, link_b))
    kept = _forest(a, b)
    some = np.flatnonzero(counts)
    return np.concatenate((uid[some], a[kept])), np.concatenate((np.full(len(some), -1), b[kept])), np.concatenate((counts[some], np.zeros(len(kept), np.int64)))


def keyed(rows: DataFrame) -> DataFrame:
    """Adds to rows (id, label, vec) the digest of a usable vector; null for others, and without a label or id."""

    def run(batches):
        for batch in batches:
            column, keys = batch.column(2), []
            flat = column.flatten().to_numpy(zero_copy_only=False) + 0.0  # without negative zeros
            known = np.asarray(batch.column(0).is_valid()) & np.asarray(batch.column(1).is_valid())
            ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0)))
            start = 0
            for fine, end in zip(known.tolist(), ends.tolist()):
                x, start = flat[start:end], end
                keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if fine and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], ["id", "label", "vec", "key"])

    return rows.mapInArrow(run, f"id long, label {rows.schema['label'].dataType.simpleString()}, vec array<double>, key binary")


def packed(vectors: DataFrame) -> DataFrame:
    """Vectors (uid, label, key, copies, least, vec) with their length and coordinates, and as bytes: four a number where
    that loses nothing."""

    def run(batches):
        for batch in batches:
            dims = np.asarray(pa.compute.list_value_length(batch.column(5)))
            for n in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == n))
                x = _flat(part.column(5))
                with np.errstate(over="ignore"):
                    single = x.astype("<f4")
                short = (single == x).all(1).tolist()
                vec = [(a if s else b).tobytes() for s, a, b in zip(short, single, x.astype("<f8"))]
                coords = [c.tobytes() for c in _coordinates(x)]
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(np.full(len(vec), n, np.int32)), pa.array(vec, pa.binary()), pa.array(coords, pa.binary())], names)

    names = ["uid", "label", "key", "copies", "least", "dims", "vec", "coords"]
    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select(*names[:5], "vec").mapInArrow(run, f"uid long, label {kind}, key binary, copies long, least long, dims int, vec binary, coords binary")


def candidates(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS) -> DataFrame:
    """Over distinct vectors (uid, label, dims, coords, grid): rows (label, dims, block, cell, i, j, role, uid), where a vector
    is within a block's budget of another one of the tile (i, j) of a cell."""

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            dims, grid = np.asarray(batch.column(2)), np.asarray(batch.column(4))
            for n, g in sorted(set(zip(dims.tolist(), grid.tolist()))):
                part = batch.filter(pa.array((dims == n) & (grid == g)))
                coords = np.frombuffer(b"".join(part.column(3).to_pylist()), "<i2").reshape(-1, n)
                for k, ((lo, hi), budget) in enumerate(zip(_cuts(n, blocks), _budgets(n, cosine, blocks))):
                    radius = float(np.sqrt(budget))
                    at, cell, home = _cells(coords[:, lo : min(hi, lo + g)], radius, WIDTH * radius)
                    own = pa.array([c.tobytes() for c in np.ascontiguousarray(coords[:, lo:hi])], pa.binary())
                    take = part.select([1, 2, 0]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([take.column(0), take.column(1), pa.array(np.full(len(at), k, np.int32)), pa.array(cell), pa.array(home), take.column(2), own.take(pa.array(at))], ["label", "dims", "block", "cell", "home", "uid", "near"])

    kind = vectors.schema["label"].dataType.simpleString()
    placed = vectors.select("uid", "label", "dims", "coords", "grid").mapInArrow(place, f"label {kind}, dims int, block int, cell long, home boolean, uid long, near binary")
    key = ["label", "dims", "block", "cell"]
    sizes = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") * F.greatest(F.col("dims") / 64, F.lit(1.0)) / CELL_ROWS).cast("int")
    big = written(sizes.withColumn("parts", parts).where("parts > 1").drop("n"), "big-cells")
    tiled = placed.join(F.broadcast(big) if big.count() <= 10_000 else big, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")
    tiled = tiled.withColumn("own", own)
    whole = tiled.where("parts = 1").withColumn("i", F.lit(0)).withColumn("j", F.lit(0)).withColumn("role", F.when(F.col("home"), 0).otherwise(1))
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    split = tiled.where("parts > 1")
    as_home = split.where("home").withColumn("i", F.col("own")).withColumn("j", each).withColumn("role", F.lit(2))
    as_seen = split.withColumn("i", each).withColumn("j", F.col("own")).withColumn("role", F.lit(1))
    rows = whole.unionByName(as_home).unionByName(as_seen).select(*key, "i", "j", "role", "uid", "near")

    def promising(table: pa.Table) -> pa.Table:
        return _promising(table, cosine, blocks).drop_columns(["near"])

    return rows.groupBy(*key, "i", "j").applyInArrow(promising, f"label {kind}, dims int, block int, cell long, i int, j int, role int, uid long")


def links(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS) -> DataFrame:
    """Over distinct vectors (uid, label, dims, copies, vec, coords, grid): rows (a, b, n); n > 0 says that vector a has n more
    links, n = 0 that a and b are linked. The latter are few, but connect all that is linked."""

    def verify(table: pa.Table) -> pa.Table:
        return pa.table([pa.array(x, pa.int64()) for x in _verify(table, cosine, blocks)], ["a", "b", "n"])

    near = written(candidates(vectors, cosine, blocks), "vector-candidates")
    some = vectors.join(near.select("uid").distinct(), "uid", "left_semi").select("uid", "copies", "coords", "vec")
    some = written(some, "vectors-met")
    rows = near.join(some.hint("merge"), "uid")  # Spark takes a table of vectors for small
    return rows.groupBy("label", "dims", "block", "cell", "i", "j").applyInArrow(verify, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, blocks: int = BLOCKS) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector."""
    rows = keyed(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vec")))
    valid = rows.where("key is not null")
    distinct = valid.groupBy("label", "key").agg(F.first("vec").alias("vec"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    distinct = written(packed(distinct.withColumn("uid", F.monotonically_increasing_id())), "vectors")  # ids may repeat, uid doesn't
    per_label = distinct.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TARGET_ROWS)  # few: rows / TARGET_ROWS
    wanted = F.ceil(F.log(F.col("n") / TARGET_ROWS) / float(np.log(3)))
    per_label = per_label.select("label", F.least(F.lit(8), wanted.cast("int") + 1).alias("grid"))
    sized = distinct.join(F.broadcast(per_label), "label", "left").withColumn("grid", F.coalesce("grid", F.lit(1)))
    found = written(links(sized, cosine, blocks), "vector-links")
    counts = found.where("n > 0").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("others"))
    roots = components(found.where("n = 0").select("a", "b"))
    lines = distinct.select("uid", "label", "key", "copies", "least")  # from here on without vectors
    named = lines.join(counts, "uid", "left").join(roots.withColumnRenamed("node", "uid"), "uid", "left")
    named = named.select("label", "key", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "uid").alias("root"), "least")
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = attach(named, first, ["root"], hot_groups(named, ["root"], HOT)).select("label", "key", "n_links", "component_id")
    thin = written(rows.select("id", "label", "key"), "vector-keys")
    same = thin.where("key is not null")
    linked = attach(same, named, ["label", "key"], hot_groups(same, ["label", "key"], HOT)).select("id", "n_links", "component_id")
    alone = thin.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
