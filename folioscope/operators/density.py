"""Density clusters with outliers (-1): a hierarchical clustering by mutual reachability, exact at any size.

1. Equal vectors become one point with a number of copies, so no vector is hot. Points are dealt to cells, the leaves of
   a k-d tree whose splits come from a bounded sample; every point is in a cell, and a cell's bounding box is
   exact. Two boxes' distance says whether their points have to be compared.
2. Core distances: a point's distance to its k-th other one. Its own cell bounds that distance; a point goes to the
   cells whose boxes are within its bound, as matrix blocks; only distances under the bound leave a task.
3. The minimum spanning tree in Boruvka rounds: every component takes its least edge to another one, in
   the total order (weight, point, point). Edges within cells bound it, and a point goes to the cells whose boxes are
   within its component's bound.
4. The tree's edges are merged lightest first, STEP_EDGES at a time, and condensed at once: a component under the
   least size only says when its points leave a cluster. What stays is a tree of clusters, not of points;
   the excess of mass selects among them.

Defined results: points that belong to no selected cluster are -1, all of them where no two clusters
separate; weights of 0 (many equal vectors) count as LEAST_WEIGHT; rows without a vector are left out; an empty table
gives no rows; ties go by the total order of edges.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.vectors import as_doubles
from folioscope.sources.places import written

#: Points that a cell is meant to hold, rows of the sample its splits come from, and edges merged at once.
CELL_POINTS, SAMPLE, STEP_EDGES = 2_048, 100_000, 500_000
#: Rows of one side of a block of distances; cells of which the driver knows the boxes: SAMPLE / 8 at most.
BLOCK_ROWS = 512
LEAST_WEIGHT = 1e-9
_EDGE = "comp long, other long, w double, u long, v long"


# ---- cells

def kd_splits(sample: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """Nodes (dimension, value, node of the lower side, of the other); a leaf is -1 - its cell. The largest leaf is
    split at the median of its widest dimension, as long as that separates anything."""
    nodes: list[list] = []
    leaves = [(-len(sample), 0, sample, None, 0)]
    done, made = [], 1
    while leaves and len(leaves) + len(done) < cells:
        leaves.sort(key=lambda x: x[:2])
        _, number, rows, parent, side = leaves.pop(0)
        wide = int(np.argmax(rows.max(0) - rows.min(0))) if len(rows) else 0
        value = float(np.median(rows[:, wide])) if len(rows) else 0.0
        low = rows[:, wide] <= value if len(rows) else np.zeros(0, bool)
        if len(rows) < 2 or low.all() or not low.any():
            done.append((number, parent, side))
            continue
        at = len(nodes)
        nodes.append([wide, value, None, None])
        if parent is not None:
            nodes[parent][2 + side] = at
        leaves += [(-int(low.sum()), made, rows[low], at, 0), (-int((~low).sum()), made + 1, rows[~low], at, 1)]
        made += 2
    for cell, (parent, side) in enumerate([x[3:] for x in leaves] + [x[1:] for x in done]):
        if parent is not None:
            nodes[parent][2 + side] = -1 - cell
    return [tuple(n) for n in nodes]


def _cells_of(x: np.ndarray, splits) -> np.ndarray:
    at = np.zeros(len(x), np.int64) if splits else np.full(len(x), -1)
    while (live := np.flatnonzero(at >= 0)).size:
        dims, values, low, high = (np.array([splits[i][k] for i in at[live]]) for k in range(4))
        at[live] = np.where(x[live, dims.astype(int)] <= values, low, high)
    return -1 - at


def in_cells(points: DataFrame, splits) -> DataFrame:
    """(point, copies, v) -> cell, points, copies, flat (the vectors back to back), lo, hi: a row per cell."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.array(b.column("v").to_pylist(), float)
                yield pa.RecordBatch.from_arrays([pa.array(_cells_of(x, splits)), *[b.column(c) for c in ("point", "copies", "v")]], names=["cell", "point", "copies", "v"])

    rows = points.mapInArrow(run, "cell long, point long, copies long, v array<double>")
    own = F.array_sort(F.collect_list(F.struct("point", "copies", "v")))
    packed = rows.groupBy("cell").agg(own.alias("own")).select("cell", F.col("own.point").alias("points"), F.col("own.copies").alias("copies"), F.flatten("own.v").alias("flat"))
    return packed


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Summed dimension by dimension, so that both directions give the same number."""
    out = np.zeros((len(x), len(y)))
    for d in range(x.shape[1]):
        out += np.square(x[:, d, None] - y[None, :, d])
    return np.sqrt(out)


def _block(b: pa.RecordBatch, i: int, end: str = ""):
    """A row's points, copies and vectors."""
    points, copies, flat = (np.array(b.column(c + end)[i].values) for c in ("points", "copies", "flat"))
    return points, copies, flat.reshape(len(points), -1)


def _kth(dist: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """By row the distance at which k copies are reached; infinite where there are fewer."""
    order = np.argsort(dist, 1, kind="stable")
    reached = np.cumsum(np.take_along_axis(np.broadcast_to(copies, dist.shape), order, 1), 1)
    at = (reached < k).sum(1)
    near = np.take_along_axis(dist, order, 1)
    return np.where(at < dist.shape[1], near[np.arange(len(dist)), np.minimum(at, dist.shape[1] - 1)], np.inf)


class Boxes:
    """The cells' boxes on the driver and in closures: at most SAMPLE / 8 rows."""

    def __init__(self, cells, lo, hi, size):
        self.cells, self.lo, self.hi, self.size = np.array(cells), np.array(lo, float), np.array(hi, float), np.array(size)

    def nearest(self, i: int) -> np.ndarray:
        return np.sqrt((np.maximum(0, np.maximum(self.lo[i] - self.hi, self.lo - self.hi[i])) ** 2).sum(1))

    def farthest(self, i: int) -> np.ndarray:
        return np.sqrt((np.maximum(np.abs(self.hi[i] - self.lo), np.abs(self.hi - self.lo[i])) ** 2).sum(1))

    def from_points(self, x: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Distances of points to some boxes, summed as _distances are (and a little less, so that none is over them)."""
        out = np.zeros((len(x), len(j)))
        for d in range(x.shape[1]):
            out += np.square(np.maximum(0, np.maximum(self.lo[j, d] - x[:, d, None], x[:, d, None] - self.hi[j, d])))
        return np.sqrt(out) * (1 - 1e-12)


def _boxes(blocks: DataFrame) -> Boxes:
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                _, copies, x = _block(b, i)
                yield pa.RecordBatch.from_pydict({"cell": b.column("cell").slice(i, 1), "lo": pa.array([x.min(0)]), "hi": pa.array([x.max(0)]), "size": pa.array([int(copies.sum())])})

    rows = blocks.mapInArrow(run, "cell long, lo array<double>, hi array<double>, size long").orderBy("cell").collect()
    return Boxes(*zip(*rows))


_ASK = "cell_b long, points array<long>, flat array<double>"


def _asks(points, x, limits, at: int, boxes: Boxes, least: np.ndarray, more: dict, skip=None):
    """A batch for every other box: the points whose limit its distance (`least` counts as one, too) does not pass. skip: points
    by boxes that are no pair."""
    near = np.maximum(boxes.nearest(at) * (1 - 1e-12), least)
    near[at] = np.inf
    every = np.flatnonzero(near <= limits.max(initial=-1.0))
    for start in range(0, len(every), 256):
        j = every[start : start + 256]
        hit = np.maximum(boxes.from_points(x, j), least[j]) <= limits[:, None]
        if skip is not None:
            hit &= ~skip(j)
        for col in np.flatnonzero(hit.any(0)).tolist():
            own = np.flatnonzero(hit[:, col])
            # one at a time: outliers may reach every box
            yield pa.RecordBatch.from_pydict({"cell_b": pa.array([int(boxes.cells[j[col]])]), "points": pa.array([points[own]], pa.list_(pa.int64())), "flat": pa.array([x[own].ravel()], pa.list_(pa.float64()))} | {c: pa.array([v[own]], pa.list_(k)) for c, (v, k) in more.items()})


def _asked(asks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Points beside the cells that they go to (names end in _b): a cell's rows are shuffled once, not once a pair."""
    return asks.join(blocks.toDF(*[f"{c}_b" for c in blocks.columns]), "cell_b")


# ---- core distances

def core_distances(blocks: DataFrame, boxes: Boxes, k: int) -> DataFrame:
    """(point, core): the distance to the k-th other point, copies counted (infinite with fewer points)."""
    place = {c: i for i, c in enumerate(boxes.cells.tolist())}

    def farthest(i: int) -> float:
        """Within it every point of a box has k others, if there are as many."""
        far = boxes.farthest(i)
        order = np.argsort(far)
        enough = int((np.cumsum(boxes.size[order]) < k + 1).sum())
        return float(far[order[enough]]) * (1 + 1e-12) if enough < len(order) else np.inf

    def own(batches):
        for b in batches:
            for i in range(b.num_rows):
                points, copies, x = _block(b, i)
                least, few = [], min(k + 1, len(x))
                for at in range(0, len(x), BLOCK_ROWS):
                    dist = _distances(x[at : at + BLOCK_ROWS], x)
                    best = np.argpartition(dist, few - 1, 1)[:, :few]
                    got = np.take_along_axis(dist, best, 1)
                    least.append(_kth(got, copies[best], k + 1))
                    rows = np.repeat(points[at : at + BLOCK_ROWS], few)
                    yield pa.RecordBatch.from_pydict({"cell_b": pa.nulls(len(rows), pa.int64()), "points": pa.nulls(len(rows), pa.list_(pa.int64())), "flat": pa.nulls(len(rows), pa.list_(pa.float64())), "limits": pa.nulls(len(rows), pa.list_(pa.float64())), "point": pa.array(rows), "d": pa.array(got.ravel()), "n": pa.array(copies[best].ravel())})
                limits = np.concatenate(least)
                at = place[b.column("cell")[i].as_py()]
                if np.isinf(limits).any():
                    limits = np.minimum(limits, farthest(at))
                for asked in _asks(points, x, limits, at, boxes, np.zeros(len(place)), {"limits": (limits, pa.float64())}):
                    yield pa.RecordBatch.from_arrays([*asked.columns, *(pa.nulls(1, t) for t in (pa.int64(), pa.float64(), pa.int64()))], names=[*asked.schema.names, "point", "d", "n"])

    both = written(blocks.mapInArrow(own, f"{_ASK}, limits array<double>, point long, d double, n long"), "density-asks")
    rows = both.filter("point IS NOT NULL").select("point", "d", "n")

    def near(batches):
        for b in batches:
            for i in range(b.num_rows):
                points, limits = (np.array(b.column(c)[i].values) for c in ("points", "limits"))
                x = np.array(b.column("flat")[i].values).reshape(len(points), -1)
                _, copies, y = _block(b, i, "_b")
                for at in range(0, len(x), BLOCK_ROWS):
                    dist = _distances(x[at : at + BLOCK_ROWS], y)
                    few = min(k + 1, dist.shape[1])
                    best = np.argpartition(dist, few - 1, 1)[:, :few]
                    got = np.take_along_axis(dist, best, 1)
                    row, col = np.nonzero(got <= limits[at : at + BLOCK_ROWS, None])
                    yield pa.RecordBatch.from_pydict({"point": pa.array(points[at + row]), "d": pa.array(got[row, col]), "n": pa.array(copies[best[row, col]])})

    if len(boxes.cells) > 1:
        asks = both.filter("point IS NULL").select("cell_b", "points", "flat", "limits")
        rows = rows.unionByName(_asked(asks, blocks).mapInArrow(near, "point long, d double, n long"))
    far, none = F.lit(float("inf")), F.lit(0).cast("long")
    step = lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.when((s["seen"] <= k) & (s["seen"] + x["n"] > k), x["d"]).otherwise(s["core"]).alias("core"))
    reached = F.aggregate(F.array_sort(F.collect_list(F.struct("d", "n"))), F.struct(none.alias("seen"), far.alias("core")), step)
    return rows.groupBy("point").agg(reached["core"].alias("core"))


# ---- the spanning tree

def _least_edges(points, comps, core, x, points_b, comps_b, core_b, y):
    """Each component's least edge to another one between two rows of points, both directions at once."""
    best: dict[int, tuple] = {}
    for at in range(0, len(x), BLOCK_ROWS):
        part = slice(at, at + BLOCK_ROWS)
        w = np.maximum(_distances(x[part], y), np.maximum(core[part, None], core_b[None, :]))
        w = np.maximum(w, LEAST_WEIGHT)
        w[comps[part, None] == comps_b[None, :]] = np.inf
        for own, other, ids, ids_b, m in ((comps[part], comps_b, points[part], points_b, w), (comps_b, comps[part], points_b, points[part], w.T)):
            names, place = np.unique(own, return_inverse=True)
            least = np.full(len(names), np.inf)
            np.minimum.at(least, place, m.min(1))
            row, col = np.nonzero((m == least[place][:, None]) & np.isfinite(m))
            if not len(row):
                continue
            u, v = np.minimum(ids[row], ids_b[col]), np.maximum(ids[row], ids_b[col])
            order = np.lexsort((v, u, place[row]))
            first = order[np.flatnonzero(np.diff(place[row][order], prepend=-1))]
            for i in first.tolist():
                edge = (float(m[row[i], col[i]]), int(u[i]), int(v[i]), int(other[col[i]]))
                comp = int(own[row[i]])
                if comp not in best or edge < best[comp]:
                    best[comp] = edge
    return best


def _edge_batch(best: dict[int, tuple]) -> pa.RecordBatch:
    rows = [(c, o, w, u, v) for c, (w, u, v, o) in best.items()]
    cols = list(zip(*rows)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["comp", "other", "w", "u", "v"])


def _arrays(b, i, end=""):
    points = np.array(b.column("points" + end)[i].values)
    return points, np.array(b.column("comps" + end)[i].values), np.array(b.column("cores" + end)[i].values), np.array(b.column("flat" + end)[i].values).reshape(len(points), -1)


def _within(batches):
    for b in batches:
        for i in range(b.num_rows):
            own = _arrays(b, i)
            yield _edge_batch(_least_edges(*own, *own))


def _between(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield _edge_batch(_least_edges(*_arrays(b, i), *_arrays(b, i, "_b")))


def _crossing(boxes: Boxes, least: np.ndarray, alone: np.ndarray):
    """Points go to the cells that their component's bound reaches: not to those that are of their component alone."""
    place = {c: i for i, c in enumerate(boxes.cells.tolist())}

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                points, comps, cores, x = _arrays(b, i)
                limits = np.array(b.column("limits")[i].values)
                # the weight is at least the core distance
                live = np.flatnonzero(cores <= limits)
                points, comps, cores, x = points[live], comps[live], cores[live], x[live]
                more = {"comps": (comps, pa.int64()), "cores": (cores, pa.float64())}
                yield from _asks(points, x, limits[live], place[b.column("cell")[i].as_py()], boxes, least, more, lambda j: comps[:, None] == alone[j][None, :])  # noqa: B023

    return run


def _roots(hooks: DataFrame) -> DataFrame:
    """(comp, other) -> (comp, root): everyone points to another one, mutual pairs to the lesser; followed to the end."""
    back = hooks.select(F.col("comp").alias("other"), F.col("other").alias("again"))
    now = written(hooks.join(back, "other").select("comp", F.when((F.col("again") == F.col("comp")) & (F.col("comp") < F.col("other")), F.col("comp")).otherwise(F.col("other")).alias("root")), "density-roots")
    while True:
        step = now.select(F.col("comp").alias("root"), F.col("root").alias("next"))
        after = written(now.join(step, "root").select("comp", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "density-roots")
        if after.filter("moved").limit(1).count() == 0:
            return after.select("comp", "root")
        now = after.select("comp", "root")


def spanning_tree(blocks: DataFrame, boxes: Boxes, cores: DataFrame) -> DataFrame:
    """(w, u, v): the minimum spanning tree of mutual reachability distances over all points."""
    cell_of = blocks.select("cell", F.explode("points").alias("point"))
    flat = written(cell_of.join(cores, "point").select("cell", "point", "core"), "density-cores")
    low = {r.cell: (r.least, r.most) for r in flat.groupBy("cell").agg(F.min("core").alias("least"), F.max("core").alias("most")).collect()}
    least, most = (np.array([low[c][i] for c in boxes.cells.tolist()]) for i in (0, 1))
    labels, parts = flat.select("cell", "point", "core", F.col("point").alias("comp")), []
    while True:
        own = F.array_sort(F.collect_list(F.struct("point", "comp", "core")))
        marks = labels.groupBy("cell").agg(own.alias("own"), F.min("comp").alias("a"), F.max("comp").alias("b")).select("cell", F.col("own.comp").alias("comps"), F.col("own.core").alias("cores"), "a", "b")
        marked = written(blocks.join(marks, "cell"), "density-marked")
        state = {r.cell: r.a if r.a == r.b else -1 for r in marked.select("cell", "a", "b").collect()}
        alone = np.array([state[c] for c in boxes.cells.tolist()])
        if (alone >= 0).all() and len(set(alone.tolist())) == 1:
            none = flat.select(F.lit(0.0).alias("w"), F.col("point").alias("u"), F.col("point").alias("v")).limit(0)
            return reduce(DataFrame.unionByName, parts, none)
        # a cell of one component has no edge within
        found = written(marked.filter("a <> b").mapInArrow(_within, _EDGE), "density-edges")
        pick = F.min(F.struct("w", "u", "v", "other")).alias("e")
        if len(boxes.cells) > 1:
            beyond: dict[int, float] = {}
            for i in np.flatnonzero(alone >= 0):
                # the nearest cell with a point of another component bounds the least edge, too
                far = np.maximum(np.maximum(boxes.farthest(i), most), most[i])[alone != alone[i]].min() * (1 + 1e-12)
                beyond[int(alone[i])] = min(beyond.get(int(alone[i]), np.inf), float(max(far, LEAST_WEIGHT)))
            known = found.select("comp", "w")
            if beyond:
                known = known.unionByName(found.sparkSession.createDataFrame(list(beyond.items()), "comp long, w double"))
            bound = known.groupBy("comp").agg(F.min("w").alias("bound"))
            own = F.array_sort(F.collect_list(F.struct("point", "bound")))
            limits = labels.join(bound, "comp").groupBy("cell").agg(own.alias("own")).select("cell", F.col("own.bound").alias("limits"))
            asks = marked.select("cell", "points", "comps", "cores", "flat").join(limits, "cell").mapInArrow(_crossing(boxes, least, alone), f"{_ASK}, comps array<long>, cores array<double>")
            crossing = _asked(asks, marked.select("cell", "points", "comps", "cores", "flat")).mapInArrow(_between, _EDGE)
            found = found.unionByName(crossing)
        chosen = written(found.groupBy("comp").agg(pick).select("comp", "e.*"), "density-chosen")
        parts.append(chosen.select("w", "u", "v").distinct())
        labels = written(labels.join(_roots(chosen.select("comp", "other")), "comp").select("cell", "point", "core", F.col("root").alias("comp")), "density-labels")


# ---- the condensed tree

_EVENTS = "kind string, node long, into long, size long, cluster long, parent long, lam double"


def _condense(least_size: int):
    """Merge a step's edges, lightest first; one row per touched node (where it went, and from which cluster
    it fell if it was small) and one per cluster that met another (its parent)."""

    def run(batches):
        parent: dict[int, int] = {}
        state: dict[int, tuple[int, int | None]] = {}
        fell: dict[int, tuple[int, float]] = {}
        members: dict[int, list[int]] = {}
        out, edges = [], []
        for b in batches:
            edges += zip(*(b.column(c).to_pylist() for c in ("w", "u", "v", "edge", "a", "size_a", "cluster_a", "b", "size_b", "cluster_b")))
        edges.sort(key=lambda e: e[:3])

        def root(n, size, cluster):
            if n not in parent:
                parent[n], state[n] = n, (size, cluster)
                members[n] = [] if size >= least_size else [n]
            while parent[n] != n:
                parent[n] = n = parent[parent[n]]
            return n

        for w, _, _, edge, a, size_a, cluster_a, b, size_b, cluster_b in edges:
            a, b, lam = root(a, size_a, cluster_a), root(b, size_b, cluster_b), 1 / w
            (na, ka), (nb, kb) = state[a], state[b]
            if ka is not None and kb is not None:
                cluster = 2 * edge + 1
                out += [("cluster", None, None, na, ka, cluster, lam), ("cluster", None, None, nb, kb, cluster, lam)]
            else:
                cluster = ka if ka is not None else kb
                if cluster is None and na + nb >= least_size:
                    cluster = 2 * edge + 1
            if len(members[a]) < len(members[b]):
                a, b = b, a
            parent[b], state[a] = a, (na + nb, cluster)
            waiting = members[a]
            waiting += members.pop(b)
            if cluster is not None:
                for n in waiting:
                    fell[n] = cluster, lam
                members[a] = []
        for n in parent:
            top = root(n, 0, None)
            size, cluster = state[top]
            at = fell.get(n, (None, None))
            out.append(("node", n, top, size, cluster, *at))
        for i in range(0, len(out), 20_000):
            cols = zip(*out[i : i + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.string(), *[pa.int64()] * 5, pa.float64()))], names=[c.split()[0] for c in _EVENTS.split(", ")])

    return run


def condensed(points: DataFrame, cores: DataFrame, tree: DataFrame, least_size: int) -> tuple[DataFrame, DataFrame]:
    """(point, copies, cluster, lam): the cluster that a point fell from and when; and (cluster, parent, lam, size) of all
    clusters that met another. A step is one task of at most STEP_EDGES edges and their nodes."""
    tree = written(tree.select("w", "u", "v", F.monotonically_increasing_id().alias("edge")), "density-numbered")
    # copies of a point meet at its core distance; enough of them are a cluster by themselves
    many = F.col("copies") >= least_size
    lam = 1 / F.greatest("core", F.lit(LEAST_WEIGHT))
    nodes = points.select("point", "copies").join(cores, "point").select("point", "copies", F.col("point").alias("node"), F.col("copies").alias("size"), F.when(many, 2 * F.col("point")).alias("cluster"), F.when(many, 2 * F.col("point")).alias("fell"), F.when(many, lam).alias("lam"))
    nodes, met = written(nodes, "density-nodes"), None
    n = tree.count()
    steps = -(-n // STEP_EDGES)
    # edges of a step: at most about STEP_EDGES by quantiles of weight; equal weights stay together only in part, by u
    order = tree.select("w", "u", "v", "edge")
    if steps > 1:
        dealt = order.repartitionByRange(steps, "w", "u", "v").select("*", F.spark_partition_id().alias("step"))
        order = written(dealt, "density-steps")
        numbers = sorted(r[0] for r in order.select("step").distinct().collect())
    else:
        order, numbers = order.withColumn("step", F.lit(0)), [0] * (n > 0)
    for number in numbers:
        side = lambda end: nodes.select(F.col("point").alias("uv"[end == "b"]), F.col("node").alias(end), F.col("size").alias(f"size_{end}"), F.col("cluster").alias(f"cluster_{end}"))  # noqa: E731,B023
        rows = order.filter(F.col("step") == number).join(side("a"), "u").join(side("b"), "v")
        events = written(rows.coalesce(1).mapInArrow(_condense(least_size), _EVENTS), "density-events")
        gone = events.filter("kind = 'node'").select("node", "into", F.col("size").alias("new_size"), F.col("cluster").alias("new_cluster"), F.col("parent").alias("new_fell"), F.col("lam").alias("new_lam"))
        pairs = events.filter("kind = 'cluster'").select("cluster", "parent", "lam", "size")
        met = pairs if met is None else met.unionByName(pairs)
        is_new = F.col("into").isNotNull()
        pick = lambda new, old: F.when(is_new, F.col(new)).otherwise(F.col(old)).alias(old)
        nodes = written(nodes.join(gone, "node", "left").select("point", "copies", pick("into", "node"), pick("new_size", "size"), pick("new_cluster", "cluster"), F.coalesce("fell", "new_fell").alias("fell"), F.coalesce("lam", "new_lam").alias("lam")), "density-nodes")
    if met is None:
        met = points.sparkSession.createDataFrame([], "cluster long, parent long, lam double, size long")
    return nodes.select("point", "copies", F.col("fell").alias("cluster"), "lam"), met


def excess_of_mass(clusters: list[tuple[int, int | None, float]], own: dict[int, float], below: dict[int, list[int]]) -> dict[int, int]:
    """cluster -> the selected cluster that it is part of. clusters: (cluster, parent, birth); own: stability.

    A cluster is selected if it is at least as stable as what is selected below it; the root never is."""
    roots = [c for c, parent, _ in clusters if parent is None]
    order, stack = [], list(roots)
    while stack:
        order.append(c := stack.pop())
        stack += below.get(c, [])
    worth, best = {}, set()
    for c in reversed(order):
        under = sum(worth[x] for x in below.get(c, []))
        if c not in roots and own[c] >= under:
            worth[c] = own[c]
            best.add(c)
        else:
            worth[c] = under
    out: dict[int, int] = {}
    parents = {c: parent for c, parent, _ in clusters}
    for c in order:
        above = out.get(parents[c])
        if above is not None:
            out[c] = above
        elif c in best:
            out[c] = c
    return out


def clusters(vectors: DataFrame, least_size: int = 10, k: int | None = None, *, id_col: str = "doc_id", vector_col: str = "embedding") -> DataFrame:
    """id, topic_id: numbers from 0 by size (then by least id), -1 for outliers. k: whose distance is the core distance
    (the least size if not given). Of the tree only clusters of at least that size come to the driver."""
    rows = written(vectors.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), as_doubles(F.col(vector_col)).alias("v")), "density-rows")
    # numbered in the order of the vectors, so that ties fall alike in every run
    points = rows.groupBy("v").agg(F.count(F.lit(1)).alias("copies")).orderBy("v")
    points = written(points.select(F.monotonically_increasing_id().alias("point"), "copies", "v"), "density-points")
    n = points.count()
    if not n:
        return rows.select(F.col("id").alias(id_col), F.lit(-1).alias("topic_id"))
    k = k or least_size
    cells = min(-(-n // CELL_POINTS), SAMPLE // 8)
    splits = []
    if cells > 1:
        some = points.filter(F.pmod(F.xxhash64("point"), F.lit(max(1, n // SAMPLE))) == 0).limit(2 * SAMPLE)
        splits = kd_splits(np.array([r.v for r in some.select("v").collect()], float), cells)
    blocks = written(in_cells(points, splits), "density-blocks")
    boxes = _boxes(blocks)
    cores = written(core_distances(blocks, boxes, k), "density-core")
    # with no k others anywhere nothing is dense
    if cores.filter(F.col("core") < float("inf")).limit(1).count() == 0:
        return rows.select(F.col("id").alias(id_col), F.lit(-1).alias("topic_id"))
    fallen, met = condensed(points, cores, spanning_tree(blocks, boxes, cores), least_size)
    left = fallen.filter("cluster IS NOT NULL").groupBy("cluster").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("lam")).alias("lams")).collect()
    births = {r.cluster: (r.parent, r.lam, r.size) for r in met.collect()}
    below, own = defaultdict(list), defaultdict(float)
    for c, (parent, _, _) in births.items():
        below[parent].append(c)
    every = {r.cluster for r in left} | set(births) | set(below)
    birth = lambda c: births[c][1] if c in births else 0.0
    for r in left:
        own[r.cluster] += r.lams - r.n * birth(r.cluster)
    for c, (parent, lam, size) in births.items():
        own[parent] += size * (lam - birth(parent))
    part = excess_of_mass([(c, births[c][0] if c in births else None, birth(c)) for c in every], own, below)
    listed = points.sparkSession.createDataFrame(list(part.items()), "cluster long, chosen long")
    named = fallen.join(listed, "cluster", "left").select("point", "chosen")
    labelled = written(rows.join(points.select("point", "v"), "v").join(named, "point").select("id", "chosen"), "density-labelled")
    sizes = labelled.filter("chosen IS NOT NULL").groupBy("chosen").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).collect()
    numbers = {r.chosen: i for i, r in enumerate(sorted(sizes, key=lambda r: (-r.n, r.first)))}
    numbered = points.sparkSession.createDataFrame(list(numbers.items()), "chosen long, topic_id int")
    return labelled.join(numbered, "chosen", "left").select(F.col("id").alias(id_col), F.coalesce("topic_id", F.lit(-1)).alias("topic_id"))
