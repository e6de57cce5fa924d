"""Discovery of groups of similar tiles."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULTS
from ..functions.vectors import dot, normalised
from ..session import cut, dropped, written


def bottom_k(members: DataFrame, k: int, by: str | None = None, seed: int = 0, id_col: str = "tile_id") -> DataFrame:
    """The ``k`` members (of each value of ``by``) with the least hashes of their ids; ties by id. The same ones at any number of partitions.

    Counts by the hash's first 16 bits, combined before the shuffle, say which prefixes are in as a whole; only the one prefix
    that the bound falls into is sorted, about 1/65536 of the stratum. So nothing is sorted as a whole, and sketches of parts merge by adding counts.
    """
    stratum = F.lit(0) if by is None else F.col(by)
    rows = members.withColumns({"_h": F.xxhash64(F.col(id_col), F.lit(seed)), "_s": F.xxhash64(stratum)})
    rows = rows.withColumn("_p", F.shiftrightunsigned("_h", 48))
    counts = rows.groupBy("_s", "_p").agg(F.count("*").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))  # 65 536 rows a stratum at most
    placed = counts.withColumn("up_to", up_to)
    last = placed.groupBy("_s").agg(F.max(F.when(F.col("up_to") <= k, F.col("_p"))).alias("whole"), F.min(F.when(F.col("up_to") > k, F.struct(F.col("_p").alias("p"), (k - F.col("up_to") + F.col("n")).alias("room")))).alias("edge"))
    met = rows.join(last, "_s")
    whole = met.filter(F.col("_p") <= F.col("whole"))
    edge = met.filter(F.col("_p") == F.col("edge.p")).withColumn("_r", F.row_number().over(Window.partitionBy("_s", "_p").orderBy("_h", id_col))).filter(F.col("_r") <= F.col("edge.room"))
    return whole.select(*members.columns).unionByName(edge.select(*members.columns))


def bounded_sample(members: DataFrame, cap: int = DEFAULTS.cluster_cap, seed: int = 0, by: str | None = None) -> DataFrame:
    """At most ``cap`` members (of each value of ``by``), chosen by a hash of their id: the same ones on every run, all of them up to the cap.

    Each row says how many members there were (``total_matching``), and whether some were left out (``sampled``).
    """
    chosen = bottom_k(members, cap, by, seed)
    if by is None:
        chosen = chosen.crossJoin(F.broadcast(members.agg(F.count("*").alias("total_matching"))))  # one row
    else:
        chosen = chosen.join(members.groupBy(by).agg(F.count("*").alias("total_matching")).withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    return chosen.withColumn("sampled", F.col("total_matching") > cap)


def kmeans_labels(members: DataFrame, n_clusters: int, seed: int = 0) -> DataFrame:
    """``members(tile_id, vector)`` with ``cluster_id`` from Spark's distributed k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = members.limit(n_clusters).count()
    rows = members.withColumn("_x", array_to_vector(F.col("vector").cast("array<double>")))
    if n < 2:
        return members.withColumn("cluster_id", F.lit(0))
    model = KMeans(k=n, seed=seed, featuresCol="_x", predictionCol="cluster_id", maxIter=20).fit(rows)
    return model.transform(rows).drop("_x")


#: Vectors on either side of a block.
BLOCK = 2048
#: Pivots at most, and vectors that the choice of their number looks at.
MAX_PIVOTS = 1024
PLAN_ROWS = 4096


class PivotPlan:
    """Pivots, and which cells and rings a vector lives in and visits within a radius (ClusterJoin, Das Sarma et al., 2014).

    A vector lives in the cell of its nearest pivot. Whoever is within the radius of a vector of cell j is no further than the radius beyond the plane
    halfway between its own pivot and j's, so it visits only such cells; and as distances to j's pivot differ by
    the radius at most (triangle inequality), only three rings of the radius' width around that pivot.
    """

    def __init__(self, pivots: np.ndarray, radius: float):
        self.pivots, self.radius = pivots, radius * (1 + 1e-9) + 1e-9  # above what rounding can add
        square = (pivots**2).sum(1)
        self.square = square
        self.apart = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * pivots @ pivots.T, 0))

    def places(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each vector's home cell and ring, and (vector, cell, ring) of its visits."""
        far = np.maximum((v**2).sum(1)[:, None] + self.square[None, :] - 2 * v @ self.pivots.T, 0)
        home = far.argmin(1)
        beyond = far - far[np.arange(len(v)), home][:, None]
        who, cell = np.nonzero(beyond <= 2 * self.radius * self.apart[home] + 1e-9)
        ring = np.floor(np.sqrt(far) / self.radius).astype(np.int64)
        return home, ring[np.arange(len(v)), home], np.repeat(who, 3), np.repeat(cell, 3), (ring[who, cell][:, None] + np.array([-1, 0, 1])).ravel()

    def work(self, v: np.ndarray) -> tuple[float, float]:
        """(share of all pairs that meet, visits a vector), estimated from the vectors ``v``, some at a time."""
        parts = [self.places(v[k : k + PLAN_SLICE]) for k in range(0, len(v), PLAN_SLICE)]
        step = 3 + max(int(max(p[1].max(), p[4].max())) for p in parts)
        lives, n_lives = np.unique(np.concatenate([p[0] * step + p[1] for p in parts]), return_counts=True)
        met = visits = 0
        for p in parts:
            inside = p[3][p[4] >= 0] * step + p[4][p[4] >= 0]
            at = np.minimum(np.searchsorted(lives, inside), len(lives) - 1)
            met += int(n_lives[at[lives[at] == inside]].sum())
            visits += len(p[3])
        return met / len(v) ** 2, visits / len(v)


def pivot_plan(unit: DataFrame, n: int, radius: float) -> PivotPlan | None:
    """As many pivots as make the least work, by an estimate from a sample of bounded size; results don't depend on it. None if they leave over a quarter of all pairs."""
    sample = _matrix(bottom_k(unit, PLAN_ROWS).orderBy("tile_id").select("v").toArrow().column("v"))
    best = None
    m = 1
    while m <= min(MAX_PIVOTS, max(1, len(sample) // 4)):
        plan = PivotPlan(sample[:: len(sample) // m][:m], radius)
        pairs, visits = plan.work(sample)
        # a pair costs a product; a visit carries a vector through the shuffle, as dear as some thousand products; a pivot is a product
        cost = pairs * n + 1000 * visits + m
        if best is None or cost < best[0]:
            best = (cost, pairs, plan)
        m *= 4
    return best[2] if best[1] < 0.25 else None


def _matrix(vectors) -> np.ndarray:
    """The rows of an Arrow column of lists of one length."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))


def _placed(unit: DataFrame, plan: PivotPlan) -> DataFrame:
    """``unit`` with cell, ring, visits: a row for each vector's home, and a row for each of its visits."""
    sent = unit.sparkSession.sparkContext.broadcast(plan)
    names = [*unit.columns, "cell", "ring", "visits"]

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, PLAN_SLICE):
                piece = batch.slice(low, PLAN_SLICE)
                home, ring, who, cell, at = sent.value.places(_matrix(piece.column("v")))
                rows = piece.take(pa.array(np.concatenate([np.arange(len(home)), who])))
                more = [pa.array(np.concatenate([home, cell]).astype(np.int32)), pa.array(np.concatenate([ring, at]).astype(np.int64)), pa.array(np.arange(rows.num_rows) >= len(home))]
                yield pa.RecordBatch.from_arrays([*rows.columns, *more], names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in unit.schema)
    return unit.mapInArrow(run, f"{kinds}, cell int, ring long, visits boolean")


#: Vectors that a plan places at once.
PLAN_SLICE = 256
#: Vectors of the left block that are multiplied at once, and pairs whose distances are computed at once.
ROWS, PAIRS = 512, 1 << 16
#: Blocks of a partition at most, where all blocks meet: each task holds one partition's.
HELD = 32
#: Edges that one task may hold to finish a forest.
LAST_EDGES = 1 << 20


class Block:
    """Vectors with their ids and what else their table says of them."""

    def __init__(self, key, ids: pa.Array, v: np.ndarray, more: dict[str, np.ndarray]):
        self.key, self.ids, self.v, self.more = key, ids, v, more


def _near(a: np.ndarray, b: np.ndarray, eps: float, distances: bool):
    """(i, j, distance or None): the pairs within ``eps``, some at a time.

    Products of single floats, whose error is far below the slack, leave out the others; what is near the bound, or whose distance is asked for, is
    computed again in doubles, term by term, so that a pair has the same distance from either side and in any block.
    """
    slack = (a.shape[1] + 8) * 2.0**-22
    left, right = a.astype(np.float32), np.ascontiguousarray(b.astype(np.float32).T)
    for low in range(0, len(a), ROWS):
        alike = (left[low : low + ROWS] @ right).ravel()
        found = np.flatnonzero(alike >= 1 - eps - slack)
        for k in range(0, len(found), PAIRS):
            at = found[k : k + PAIRS]
            i, j = np.divmod(at, len(b))
            i += low
            if distances:
                d = 1 - np.einsum("ij,ij->i", a[i], b[j])
                keep = d <= eps
                yield i[keep], j[keep], d[keep]
            else:
                keep = alike[at] >= 1 - eps + slack
                ask = np.flatnonzero(~keep)
                keep[ask] = 1 - np.einsum("ij,ij->i", a[i[ask]], b[j[ask]]) <= eps
                yield i[keep], j[keep], None


def _grown(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the edges of u and v, by place, that make the forest of their order; labels after them), from components ``label``: Boruvka's rounds, earlier edges first."""
    alive, taken = np.arange(len(u)), []
    while True:
        lu, lv = label[u[alive]], label[v[alive]]
        keep = lu != lv
        alive, lu, lv = alive[keep], lu[keep], lv[keep]
        if not len(alive):
            return np.concatenate([np.zeros(0, np.int64), *taken]), label
        place = np.arange(len(alive))
        first = np.full(len(label), len(alive))
        first[lu[::-1]] = place[::-1]  # of equal ones the last write stays, the earliest edge
        other = np.full(len(label), len(alive))
        other[lv[::-1]] = place[::-1]
        first = np.minimum(first, other)
        picks = np.flatnonzero(first < len(alive))
        taken.append(alive[np.unique(first[picks])])
        up = np.arange(len(label))
        up[picks] = lu[first[picks]] + lv[first[picks]] - picks
        pair = picks[(up[up[picks]] == picks) & (picks < up[picks])]  # two that pick each other: the smaller is the root
        up[pair] = pair
        while (jump := up[up]).tobytes() != up.tobytes():
            up = jump
        label = up[label]


def _table(names: list[str], *columns) -> pa.Table:
    return pa.table([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns], names)


class Pairs:
    """(a, b[, distance]) of all pairs."""

    def __init__(self, eps: float, distances: bool):
        self.eps, self.distances, self.names = eps, distances, ["a", "b", "distance"][: 2 + distances]

    def add(self, a: Block, b: Block, both: bool):
        for i, j, d in _near(a.v, b.v, self.eps, self.distances):
            for x, i_, y, j_ in ((a, i, b, j), (b, j, a, i))[: 1 + both]:
                yield _table(self.names, x.ids.take(pa.array(i_)), y.ids.take(pa.array(j_)), *([d] if self.distances else []))

    def end(self):
        return iter(())


class Counts:
    """(a, n): neighbours, summed for what a task compares."""

    def __init__(self, eps: float):
        self.eps, self.held = eps, {}

    def add(self, a: Block, b: Block, both: bool):
        for x in (a, b):
            self.held.setdefault(x.key, (x.ids, np.zeros(len(x.ids), np.int64)))
        for i, j, _ in _near(a.v, b.v, self.eps, False):
            for x, at in ((a, i), (b, j))[: 1 + both]:
                self.held[x.key][1][:] += np.bincount(at, minlength=len(x.ids))
        return iter(())

    def end(self):
        for ids, n in self.held.values():
            some = np.flatnonzero(n)
            yield _table(["a", "n"], ids.take(pa.array(some)), n[some])


class Nearest:
    """(a, distance): the ``k`` least distances, of what a task compares."""

    def __init__(self, eps: float, k: int):
        self.eps, self.k, self.held = eps, k, {}

    def add(self, a: Block, b: Block, both: bool):
        for x in (a, b):
            self.held.setdefault(x.key, [x.ids, np.full((len(x.ids), self.k), np.inf)])
        for i, j, d in _near(a.v, b.v, self.eps, True):
            for x, at in ((a, i), (b, j))[: 1 + both]:
                order = np.lexsort((d, at))
                who, far = at[order], d[order]
                rank = np.arange(len(who)) - np.searchsorted(who, who)
                seen = np.unique(who)
                found = np.full((len(seen), self.k), np.inf)
                few = rank < self.k
                found[np.searchsorted(seen, who[few]), rank[few]] = far[few]
                best = self.held[x.key][1]
                best[seen] = np.sort(np.concatenate([best[seen], found], axis=1), axis=1)[:, : self.k]
        return iter(())

    def end(self):
        for ids, best in self.held.values():
            at, k = np.nonzero(np.isfinite(best))
            yield _table(["a", "distance"], ids.take(pa.array(at)), best[at, k])


class Links:
    """(a, b, border): links of cores that make the same components as all, of what a task compares; and all pairs of another member a with a core b.

    A member that is no core has fewer neighbours than a core, so these are few.
    """

    names = ["a", "b", "border"]

    def __init__(self, eps: float):
        self.eps, self.start, self.label = eps, {}, np.zeros(0, np.int64)

    def _rows(self, a: Block, i, b: Block, j, border: bool):
        return _table(self.names, a.ids.take(pa.array(i)), b.ids.take(pa.array(j)), np.full(len(i), border))

    def add(self, a: Block, b: Block, both: bool):
        for x in (a, b):
            if x.key not in self.start:
                self.start[x.key] = len(self.label)
                self.label = np.concatenate([self.label, np.arange(len(self.label), len(self.label) + len(x.ids))])
        for i, j, _ in _near(a.v, b.v, self.eps, False):
            ca, cb = a.more["core"][i], b.more["core"][j]
            yield self._rows(a, i[~ca & cb], b, j[~ca & cb], True)
            if both:
                yield self._rows(b, j[ca & ~cb], a, i[ca & ~cb], True)
            i, j = i[ca & cb], j[ca & cb]
            taken, self.label = _grown(self.label, self.start[a.key] + i, self.start[b.key] + j)
            yield self._rows(a, i[taken], b, j[taken], False)

    def end(self):
        return iter(())


def _ordered(a, b, weight) -> np.ndarray:
    """The places of edges in the order of weight, a, b; ids of any kind."""
    ranks = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
    return np.lexsort((ranks[len(a) :], ranks[: len(a)], weight))


class Edges:
    """(a, b, weight), a < b: the minimum spanning forest of mutual reachability, of what a task compares."""

    def __init__(self, eps: float):
        self.eps, self.start, self.n, self.pool, self.many = eps, {}, 0, [], 0

    def add(self, a: Block, b: Block, both: bool):
        for x in (a, b):
            if x.key not in self.start:
                self.start[x.key] = self.n
                self.n += len(x.ids)
        ids = [x.ids.to_numpy(zero_copy_only=False) for x in (a, b)]
        for i, j, d in _near(a.v, b.v, self.eps, True):
            x, y, u, v = ids[0][i], ids[1][j], self.start[a.key] + i, self.start[b.key] + j
            less = (x < y).astype(bool)
            if both:  # seen once, in this order or the other
                x, y = np.where(less, x, y), np.where(less, y, x)
                less = (x < y).astype(bool)
            weight = np.maximum(d, np.maximum(a.more["core"][i], b.more["core"][j]))
            self.pool.append([c[less] for c in (x, y, u, v, weight)])
            self.many += len(self.pool[-1][0])
            if self.many > max(LAST_EDGES, 2 * self.n):
                self._reduce()
        return iter(())

    def _reduce(self):
        x, y, u, v, weight = (np.concatenate(c) for c in zip(*self.pool, strict=True))
        order = _ordered(x, y, weight)
        taken = order[_grown(np.arange(self.n), u[order], v[order])[0]]
        self.pool, self.many = [[c[taken] for c in (x, y, u, v, weight)]], len(taken)

    def end(self):
        if self.pool:
            self._reduce()
            x, y, _, _, weight = self.pool[0]
            yield _table(["a", "b", "weight"], x, y, weight)


class RadiusJoin:
    """Who of ``members`` is within a cosine distance of ``eps`` of whom; ``unit`` has their ids and unit vectors.

    Where pivots save enough (:class:`PivotPlan`), each pair meets where its second vector lives; cells and rings with many vectors are dealt out in blocks of bounded size
    on either side. Else all blocks meet, each two once, and none is shuffled for it: a task reads two partitions of blocks from the shared folder, so the
    disk taken is that of the vectors once, whatever the number of pairs.
    """

    def __init__(self, members: DataFrame, eps: float):
        self.eps, self.kind = eps, members.schema["tile_id"].dataType.simpleString()
        self.unit = cut(members.select("tile_id", normalised(F.col("vector")).alias("v")).filter("v is not null"))
        self.n = self.unit.count()
        self.plan = pivot_plan(self.unit, self.n, (2 * eps) ** 0.5) if self.n else None

    def sizes(self, placed: DataFrame) -> DataFrame:
        """A row for each cell and ring that is anyone's home."""
        return cut(placed.groupBy("cell", "ring").agg(F.count_if(~F.col("visits")).alias("homes"), F.count_if("visits").alias("guests")).filter("homes > 0"))

    def run(self, make, schema: str, unit: DataFrame | None = None) -> DataFrame:
        """What ``make()`` gives for all pairs of blocks of ``unit``, some or all of the members with further columns of numbers, of ``schema``."""
        unit = self.unit if unit is None else unit
        more = [c for c in unit.columns if c not in ("tile_id", "v")]
        return self._everywhere(unit, more, make, schema) if self.plan is None else self._by_pivots(unit, more, make, schema)

    def _by_pivots(self, unit: DataFrame, more: list[str], make, schema: str) -> DataFrame:
        placed = _placed(unit, self.plan)
        met = placed.join(F.broadcast(self.sizes(placed)), ["cell", "ring"])  # a row a cell and ring: some rings of at most MAX_PIVOTS pivots
        blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
        mine = lambda c: F.pmod(F.xxhash64("tile_id", F.lit(7)), blocks(c)).cast("int")
        every = lambda c: F.sequence(F.lit(0), blocks(c) - 1)
        homes = met.filter("not visits and guests > 0").select(*unit.columns, "cell", "ring", mine("homes").alias("p"), F.explode(every("guests")).alias("q"), F.lit(False).alias("left"))
        guests = met.filter("visits").select(*unit.columns, "cell", "ring", mine("guests").alias("q"), F.explode(every("homes")).alias("p"), F.lit(True).alias("left"))

        def run(group: pa.Table) -> pa.Table:
            first = group.column("left").to_numpy(zero_copy_only=False)
            v, ids = _matrix(group.column("v")), group.column("tile_id").combine_chunks()
            columns = {c: group.column(c).to_numpy(zero_copy_only=False) for c in more}
            sides = [Block(k, ids.take(pa.array(at)), v[at], {c: x[at] for c, x in columns.items()}) for k, at in enumerate((np.flatnonzero(first), np.flatnonzero(~first)))]
            kernel = make()
            return _joined([*kernel.add(*sides, False), *kernel.end()], schema, ids.type) if len(sides[0].ids) and len(sides[1].ids) else _joined([], schema, ids.type)

        rows = guests.unionByName(homes).select(F.struct("cell", "ring", "p", "q").alias("unit"), *unit.columns, "left")
        return rows.groupBy("unit").applyInArrow(run, schema)

    def _everywhere(self, unit: DataFrame, more: list[str], make, schema: str) -> DataFrame:
        # tasks are pairs of partitions: some for each core, and none that holds many blocks
        side = math.ceil(math.sqrt(4 * unit.sparkSession.sparkContext.defaultParallelism))
        size = max(64, min(2 * BLOCK, math.ceil(self.n / (2 * side))))
        parts = max(1, min(math.ceil(self.n / size), max(side, math.ceil(self.n / size / HELD))))
        kinds = {f.name: f.dataType.simpleString() for f in unit.schema}

        def pack(batches):
            held, n = [], 0

            def block(table):
                lists = [pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column(c).combine_chunks()) for c in ("tile_id", *more)]
                return pa.RecordBatch.from_arrays([*lists, pa.array([_matrix(table.column("v")).tobytes()], pa.binary())], ["tile_id", *more, "v"])

            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                while n >= size:
                    table = pa.Table.from_batches(held)
                    yield block(table.slice(0, size))
                    held, n = table.slice(size).to_batches(), n - size
            if n:
                yield block(pa.Table.from_batches(held))

        lists = ", ".join(f"{c} array<{kinds[c]}>" for c in ("tile_id", *more))
        blocks = cut(unit.repartition(parts, "tile_id").mapInArrow(pack, f"{lists}, v binary")).withColumn("p", F.monotonically_increasing_id())
        prefixed = lambda k: blocks.select(*[F.col(c).alias(k + c) for c in blocks.columns])
        met = prefixed("l_").join(prefixed("r_").hint("shuffle_replicate_nl"), F.col("l_p") <= F.col("r_p"))

        def opened(batch, row, k):
            lists = {c: batch.column(k + c).slice(row, 1).flatten() for c in ("tile_id", *more)}
            v = np.frombuffer(batch.column(k + "v")[row].as_buffer(), np.float64).reshape(len(lists["tile_id"]), -1)
            return Block(batch.column(k + "p")[row].as_py(), lists["tile_id"], v, {c: lists[c].to_numpy(zero_copy_only=False) for c in more})

        def run(batches):
            kernel, kind = make(), None
            for batch in batches:
                for row in range(batch.num_rows):
                    a, b = opened(batch, row, "l_"), opened(batch, row, "r_")
                    kind = a.ids.type
                    yield from _batches(kernel.add(a, b, a.key != b.key), schema, kind)
            yield from _batches(kernel.end(), schema, kind)

        return met.mapInArrow(run, schema)


def _typed(table: pa.Table, schema: str, kind) -> pa.Table:
    names = {"double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return table.cast(pa.schema([(n, kind if n in ("a", "b") else names[t]) for n, t in fields]))


def _batches(tables, schema: str, kind):
    for table in tables:
        if table.num_rows:
            yield from _typed(table, schema, kind).to_batches()


def _joined(tables: list[pa.Table], schema: str, kind) -> pa.Table:
    names = [f.split()[0] for f in schema.split(", ")]
    tables = [_typed(t, schema, kind) for t in tables] or [_typed(_table(names, *[pa.array([], kind if n in ("a", "b") else pa.float64()) for n in names]), schema, kind)]
    return pa.concat_tables(tables).combine_chunks()


def join_work(members: DataFrame, eps: float) -> DataFrame:
    """One row: ``n`` vectors, ``pairs`` that :func:`neighbours` compares (both ways, of which blocks that all meet compute one), comparisons with pivots, and ``copies`` of vectors that it shuffles, blocks included."""
    join = RadiusJoin(members, eps)
    spark, kinds = members.sparkSession, "n long, pairs long, pivot_pairs long, copies long"
    if join.plan is None:
        return spark.createDataFrame([(join.n, join.n * join.n, 0, join.n)], kinds)
    blocks = lambda c: F.ceil(F.col(c) / BLOCK)
    sizes = join.sizes(_placed(join.unit, join.plan))
    return sizes.agg(F.lit(join.n).cast("long").alias("n"), F.sum(F.col("homes") * F.col("guests")).alias("pairs"), F.lit(join.n * len(join.plan.pivots)).cast("long").alias("pivot_pairs"), F.sum(F.col("homes") * blocks("guests") + F.col("guests") * blocks("homes")).alias("copies"))


def neighbours(members: DataFrame, eps: float, distances: bool = False) -> DataFrame:
    """(a, b[, distance]) with a cosine distance of at most ``eps``, both ways, itself included (a zero vector isn't its own neighbour).

    Exact, by :class:`RadiusJoin`. How much pivots save depends on the data: of vectors in many dimensions without clusters nearly all cells are
    within a wide radius, and then all blocks meet. :func:`join_work` counts it. Who only counts neighbours takes :func:`neighbour_counts`.
    """
    join = RadiusJoin(members, eps)
    return join.run(lambda: Pairs(eps, distances), f"a {join.kind}, b {join.kind}" + ", distance double" * distances)


def neighbour_counts(members: DataFrame, eps: float) -> DataFrame:
    """(a, n): how many rows of :func:`neighbours` each member with any has. Pairs are counted where they are compared, not written."""
    return _counts(RadiusJoin(members, eps))


def _counts(join: RadiusJoin) -> DataFrame:
    eps = join.eps
    return join.run(lambda: Counts(eps), f"a {join.kind}, n long").groupBy("a").agg(F.sum("n").alias("n"))


def numbered(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with ``name``: their numbers in the order of ``column`` from 0 on, sorted by ranges and numbered by part."""
    ordered = cut(rows.repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    offsets = ordered.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_part", "_before")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    return ordered.withColumn("_in", inside).join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_before") + F.col("_in")).cast("int")).drop("_part", "_before", "_in")


def components(nodes: DataFrame, linked: DataFrame, rounds: int = 40) -> DataFrame:
    """``nodes(a)`` with ``label``, the least node that each reaches by ``linked(a, b)``, which holds links both ways and each node's own."""
    label = cut(nodes.withColumn("label", F.col("a")))
    for _ in range(rounds):
        spread = linked.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("label"))
        # follow the label's own label, so that long chains shorten fast
        jump = cut(spread.join(spread.select(F.col("a").alias("label"), F.col("label").alias("next")), "label").select("a", F.least("label", "next").alias("label")))
        done = jump.join(label.withColumnRenamed("label", "was"), "a").filter("label <> was").isEmpty()
        label = jump
        if done:
            return label
    raise RuntimeError(f"labels still move after {rounds} rounds")


def reachability_edges(members: DataFrame, eps: float, min_samples: int = 5) -> DataFrame:
    """(a, b, weight), a < b: edges that have the minimum spanning forest of mutual reachability within ``eps`` among them.

    An edge is between members within ``eps`` that both have ``min_samples`` neighbours there, themselves included. It weighs the largest of the distance and the two core distances,
    a member's distance to its ``min_samples``-th neighbour. Each task gives the forest of the edges it sees (what is the largest on a cycle there is so among all edges), so
    rows are as many as members, times the tasks that see a member, whatever the number of pairs.
    """
    join = RadiusJoin(members.filter("tile_id is not null"), eps)
    least = join.run(lambda: Nearest(eps, min_samples), f"a {join.kind}, distance double")
    place = F.row_number().over(Window.partitionBy("a").orderBy("distance"))
    core = least.withColumn("place", place).filter(F.col("place") == min_samples).select(F.col("a").alias("tile_id"), F.col("distance").alias("core"))
    return join.run(lambda: Edges(eps), f"a {join.kind}, b {join.kind}, weight double", cut(join.unit.join(core, "tile_id")))


def _finished(edges: DataFrame, schema: str, rows) -> DataFrame:
    """What ``rows(table)`` gives of at most LAST_EDGES edges, in one task."""

    def run(batches):
        held = list(batches)
        if held:
            yield from rows(pa.Table.from_batches(held)).to_batches()

    return edges.coalesce(1).mapInArrow(run, schema)


def _places(*columns) -> tuple[np.ndarray, list[np.ndarray]]:
    """The ids in all columns in order, and each column as places among them."""
    ids, at = np.unique(np.concatenate(columns), return_inverse=True)
    return ids, np.split(at, np.cumsum([len(c) for c in columns])[:-1])


def spanning_forest(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """The minimum spanning forest of ``edges(a, b, weight)``, a < b, by Boruvka's rounds; equal weights are in the order of a and b.

    In a round every component picks its least edge to another (an aggregation, combined before its shuffle), components that picks join
    become one, and of the edges between two components only the least stays. Rounds at least halve the components, and each is a written table.
    When at most LAST_EDGES edges are left, one task of that bounded size ends it.
    """
    now = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v"), F.struct("weight", "a", "b").alias("e")))
    kind = edges.schema["a"].dataType.simpleString()

    def last(table: pa.Table) -> pa.Table:
        a, b, w, u, v = (table.column(c).to_numpy() for c in ("a", "b", "weight", "u", "v"))
        ids, (u, v) = _places(u, v)
        order = _ordered(a, b, w)
        return table.select(["a", "b", "weight"]).take(pa.array(order[_grown(np.arange(len(ids)), u[order], v[order])[0]]))

    out = edges.limit(0).select("weight", "a", "b")
    for _ in range(rounds):
        if now.count() <= LAST_EDGES:
            ended = _finished(now.select("e.a", "e.b", "e.weight", "u", "v"), f"a {kind}, b {kind}, weight double", last)
            return out.unionByName(ended).select("a", "b", "weight")
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v"), "e"))
        least = written(both.groupBy("u").agg(F.min(F.struct("e", "v")).alias("m")).select("u", F.col("m.v").alias("to"), F.col("m.e").alias("e")))
        out = out.unionAll(least.select("e.*").distinct())
        # two components that pick each other are a root, the smaller one; all others follow their picks there
        back = least.select(F.col("u").alias("to"), F.col("to").alias("back"))
        up = written(least.join(back, "to").select("u", F.when((F.col("back") == F.col("u")) & (F.col("u") < F.col("to")), F.col("u")).otherwise(F.col("to")).alias("root")))
        for _ in range(rounds):
            jump = written(up.join(up.select(F.col("u").alias("root"), F.col("root").alias("next")), "root").select("u", "root", "next"))
            moved = not jump.filter("root <> next").isEmpty()
            dropped(up)
            up = written(jump.select("u", F.col("next").alias("root")))
            dropped(jump)
            if not moved:
                break
        merged = now.join(up, "u").withColumnRenamed("root", "ru").join(up.select(F.col("u").alias("v"), F.col("root").alias("rv")), "v").filter("ru <> rv")
        before, now = now, written(merged.groupBy(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).agg(F.min("e").alias("e")))
        dropped(before, up)
    raise RuntimeError(f"components left after {rounds} rounds")


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes(a)`` with ``label``, the least node that each reaches by ``links(a, b)``; at most LAST_EDGES links and nodes in one task, more by rounds."""
    loops = nodes.select("a", F.col("a").alias("b"))
    linked = links.select("a", "b").unionAll(loops)
    if linked.count() > LAST_EDGES:
        return components(nodes, cut(linked.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))))
    kind = nodes.schema["a"].dataType.simpleString()

    def last(table: pa.Table) -> pa.Table:
        ids, (u, v) = _places(*(table.column(c).to_numpy() for c in ("a", "b")))
        label = _grown(np.arange(len(ids)), u, v)[1]
        least = np.full(len(ids), len(ids))
        least[label[::-1]] = np.arange(len(ids))[::-1]  # the first of each component in the order of ids
        return _table(["a", "label"], pa.array(ids, table.schema.field("a").type), pa.array(ids[least[label]], table.schema.field("a").type))

    return _finished(linked, f"a {kind}, label {kind}", last)


def density_levels(members: DataFrame, levels: list[float], min_samples: int = 5, min_cluster_size: int = 5) -> DataFrame:
    """``(level, root, size, parent)``: the clusters of at least ``min_cluster_size`` members at each distance of ``levels``, and which of the next wider level each lies in.

    Clusters are named by their least member. The forest is built once, within the widest level; the clusters at a level are what its edges up to there join. No task
    holds more than LAST_EDGES members. A parent of null means that there is no wider level.
    """
    levels = sorted(levels)
    forest = written(spanning_forest(reachability_edges(members, levels[-1], min_samples)))
    nodes = written(forest.select("a").unionAll(forest.select("b")).distinct())
    found, out = None, None
    for level in reversed(levels):
        label = written(_labelled(nodes, forest.filter(F.col("weight") <= level)).withColumnRenamed("label", "root"))
        sizes = label.groupBy("root").agg(F.count("*").alias("size")).filter(F.col("size") >= min_cluster_size)
        if found is None:
            rows = sizes.withColumn("parent", F.lit(None).cast(members.schema["tile_id"].dataType))
        else:
            rows = sizes.join(found.select(F.col("a").alias("root"), F.col("root").alias("parent")), "root")
        rows = rows.select(F.lit(float(level)).alias("level"), "root", "size", "parent")
        out = rows if out is None else out.unionAll(rows)
        found = label
    return out


def dbscan_labels(members: DataFrame, eps: float = 0.15, min_samples: int = 5, rounds: int = 40) -> DataFrame:
    """``(tile_id, cluster_id, is_core)``; noise has -1. Clusters are numbered by their smallest core id.

    Core points have ``min_samples`` neighbours, themselves included; cores within ``eps`` share a cluster, and
    a border point goes to the smallest cluster near it. Pairs are compared twice, to count neighbours and to link cores, and aren't written: each task
    gives as many links as join the cores it sees (:class:`Links`).
    """
    join = RadiusJoin(members.filter("tile_id is not null"), eps)
    counts = cut(_counts(join))
    core = counts.filter(F.col("n") >= min_samples).select("a")
    several = counts.filter("n > 1").select(F.col("a").alias("tile_id"), (F.col("n") >= min_samples).alias("core"))  # others have no neighbour beside themselves
    found = written(join.run(lambda: Links(eps), f"a {join.kind}, b {join.kind}, border boolean", cut(join.unit.join(several, "tile_id"))))
    links = found.filter("not border").select("a", "b")
    linked = cut(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionAll(core.select("a", F.col("a").alias("b"))))
    label = components(core, linked, rounds)
    border = found.filter("border").select("a", "b").join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("root"))
    roots = numbered(label.select(F.col("label").alias("root")).distinct(), "root", "cluster_id")
    placed = label.select("a", F.col("label").alias("root"), F.lit(True).alias("is_core")).unionAll(border.select("a", "root", F.lit(False).alias("is_core")))
    tagged = members.select(F.col("tile_id").alias("a")).join(placed, "a", "left").join(roots, "root", "left")
    return tagged.select(F.col("a").alias("tile_id"), F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), F.coalesce("is_core", F.lit(False)).alias("is_core"))


def label_counts(labels: DataFrame) -> DataFrame:
    """One row: members, clusters, cores, and members that no cluster has (noise)."""
    noise = F.col("cluster_id") < 0
    return labels.agg(F.count("*").alias("members"), F.countDistinct(F.when(~noise, F.col("cluster_id"))).alias("clusters"), F.count_if("is_core").alias("cores"), F.count_if(noise).alias("noise"))


def centroids(labelled: DataFrame) -> DataFrame:
    """(cluster_id, centroid): the unit mean vector of each cluster, by dimension sums that combine before the shuffle."""
    parts = labelled.filter("cluster_id >= 0").select("cluster_id", F.posexplode("vector").alias("d", "x"))
    means = parts.groupBy("cluster_id", "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vector = means.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("_v"))  # one entry a dimension
    return vector.select("cluster_id", normalised(F.transform("_v", lambda x: x["m"])).alias("centroid"))


def summaries(labelled: DataFrame, representatives: int = DEFAULTS.cluster_representatives) -> DataFrame:
    """One row a cluster, the largest first: size, cohesion, mean position, box, and the tiles nearest to the centroid.

    ``labelled(tile_id, vector, cluster_id, x, y)``.
    """
    near = labelled.join(centroids(labelled), "cluster_id").withColumn("sim", dot(F.col("vector"), F.col("centroid")))
    stats = near.groupBy("cluster_id").agg(F.count("*").alias("size"), F.avg("sim").alias("cohesion"), F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"), F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))
    best = near.withColumn("place", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("sim"), "tile_id"))).filter(F.col("place") <= representatives)
    tiles = best.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("place", "tile_id"))).alias("_t")).select("cluster_id", F.transform("_t", lambda t: t["tile_id"]).alias("representative_tiles"))
    return stats.join(tiles, "cluster_id").orderBy(F.desc("size"), "cluster_id")


HULL_SALTS = 32
#: Points that a task holds before it reduces them to their hulls.
HULL_ROWS = 1 << 16


def _left_turn(a, b, c) -> bool:
    """Whether c is left of the line from a to b, exactly: by doubles where their error can't matter, else by fractions."""
    left, right = (b[0] - a[0]) * (c[1] - a[1]), (b[1] - a[1]) * (c[0] - a[0])
    if abs(left - right) > 4e-15 * (abs(left) + abs(right)):
        return left > right
    (ax, ay), (bx, by), (cx, cy) = (tuple(map(Fraction, p)) for p in (a, b, c))
    return (bx - ax) * (cy - ay) > (by - ay) * (cx - ax)


def monotone_chain(points) -> list[tuple[float, float]]:
    """The corners of the points' convex hull, counter-clockwise from the least point; one or two points are their own hull."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    halves = []
    for run in (points, points[::-1]):
        half: list[tuple[float, float]] = []
        for p in run:
            while len(half) > 1 and not _left_turn(half[-2], half[-1], p):
                half.pop()
            half.append(p)
        halves += half[:-1]
    return halves


def convex_hulls(points: DataFrame, by: str) -> DataFrame:
    """(by, place, x, y): the corners of each group's convex hull, counter-clockwise from the least point, exact.

    Each task reduces what it reads to the hulls of its groups, which are merged in HULL_SALTS parts of a group and then as a whole, so
    a task holds corners of hulls, not groups. Points without both coordinates are left out; a collinear group has two corners.
    """
    kind = points.schema[by].dataType
    schema = f"{by} {kind.simpleString()}, x double, y double"

    def partial(batches):
        held: dict = {}
        size, arrow = 0, None

        def reduced():
            rows = [(g, *p) for g, ps in held.items() for p in ps]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], arrow), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.float64())], [by, "x", "y"])

        for batch in batches:
            arrow = batch.column(0).type
            for g, x, y in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.setdefault(g, []).append((x, y))
            size += batch.num_rows
            if size > HULL_ROWS:
                for g in held:
                    held[g] = monotone_chain(held[g])
                size = sum(map(len, held.values()))
                if size > HULL_ROWS // 2:  # many groups or round ones: on to the next step
                    yield reduced()
                    held, size = {}, 0
        if held:
            for g in held:
                held[g] = monotone_chain(held[g])
            yield reduced()

    def merge(rows):
        corners = monotone_chain(list(zip(rows.column("x").to_pylist(), rows.column("y").to_pylist(), strict=True)))
        group = rows.column(by).combine_chunks().take(pa.array([0] * len(corners)))
        return pa.table([group, pa.array(range(len(corners)), pa.int32()), pa.array([p[0] for p in corners], pa.float64()), pa.array([p[1] for p in corners], pa.float64())], [by, "place", "x", "y"])

    placed = f"{by} {kind.simpleString()}, place int, x double, y double"
    # adding zero makes a negative zero the same point as a positive one
    clean = points.select(by, (F.col("x").cast("double") + 0.0).alias("x"), (F.col("y").cast("double") + 0.0).alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    parts = clean.mapInArrow(partial, schema)
    salted = parts.groupBy(by, F.pmod(F.xxhash64("x", "y"), F.lit(HULL_SALTS)).alias("salt")).applyInArrow(merge, placed)
    return salted.select(by, "x", "y").groupBy(by).applyInArrow(merge, placed)


def discover(members: DataFrame, algorithm: str = "kmeans", n_clusters: int = 8, eps: float = 0.15, min_cluster_size: int = 5, cap: int | None = None) -> DataFrame:
    """Cluster summaries of ``members(tile_id, vector, x, y)``; none if there are too few members.

    All members are clustered, unless the caller asks for a :func:`bounded_sample` by ``cap``; ``total_matching`` and ``sampled`` tell.
    """
    cut_to = members if cap is None else bounded_sample(members, cap).drop("total_matching", "sampled")
    rows = cut(cut_to)
    if algorithm == "dbscan":
        labelled = rows.join(dbscan_labels(rows, eps, min_cluster_size).drop("is_core"), "tile_id")
    elif algorithm == "kmeans":
        labelled = kmeans_labels(rows, n_clusters)
    else:
        raise ValueError(f"unknown algorithm {algorithm!r}; have kmeans, dbscan")
    enough = rows.limit(max(2, min_cluster_size)).count() >= max(2, min_cluster_size)
    total = members.agg(F.count("*").alias("total_matching"))  # one row
    out = summaries(labelled if enough else labelled.limit(0)).crossJoin(F.broadcast(total))
    return out.withColumn("sampled", F.lit(False) if cap is None else F.col("total_matching") > cap).orderBy(F.desc("size"), "cluster_id")
