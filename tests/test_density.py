import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioscope.operators import density


def by_hand(x, m, k):
    """The definition over single points and all pairs: labels (-1 for outliers), numbered by size."""
    x = np.asarray(x, float)
    n = len(x)
    order = sorted(range(n), key=lambda i: (tuple(x[i]), i))
    x = x[order]
    d = np.sqrt(sum(np.square(x[:, None, j] - x[None, :, j]) for j in range(x.shape[1])))
    if n <= k:
        return [-1] * n
    core = np.sort(d, 1)[:, k]
    w = np.maximum(np.maximum(d, np.maximum(core[:, None], core[None])), density.LEAST_WEIGHT)
    same = (x[:, None] == x[None]).all(2)
    edges = sorted((w[i, j], not same[i, j], i, j) for i, j in itertools.combinations(range(n), 2))
    # equal vectors count as their first one in the order of edges
    first = [int(np.flatnonzero(same[i])[0]) for i in range(n)]
    edges = sorted((a, b, *sorted((first[i], first[j])), i, j) for a, b, i, j in edges)
    comp = {i: [i] for i in range(n)}
    at = list(range(n))
    cluster, fell, parent, birth, stab, children = {}, {}, {}, defaultdict(float), defaultdict(float), defaultdict(list)
    made = itertools.count()
    for weight, _, _, _, i, j in edges:
        a, b = at[i], at[j]
        if a == b:
            continue
        lam = 1 / weight
        ka, kb = cluster.get(a), cluster.get(b)
        union = comp[a] + comp[b]
        if ka is not None and kb is not None:
            new = next(made)
            for c, own in ((ka, comp[a]), (kb, comp[b])):
                parent[c], birth[c] = new, lam
                children[new].append((c, len(own), lam))
        else:
            new = ka if ka is not None else kb
            if new is None and len(union) >= m:
                new = next(made)
            if new is not None:
                for own, had in ((comp[a], ka), (comp[b], kb)):
                    if had is None:
                        for p in own:
                            fell[p] = new, lam
        comp[a] = union
        for p in comp.pop(b):
            at[p] = a
        cluster.pop(b, None)
        if new is not None:
            cluster[a] = new
    for p, (c, lam) in fell.items():
        stab[c] += lam - birth[c]
    for c, own in children.items():
        for _, size, lam in own:
            stab[c] += size * (lam - birth[c])
    every = {c for c, _ in fell.values()} | set(parent) | set(children)
    chosen = set()

    def worth(c):
        under = sum(worth(x) for x, _, _ in children[c])
        if c in parent and stab[c] >= under:
            drop = [x for x, _, _ in children[c]]
            while drop:
                y = drop.pop()
                chosen.discard(y)
                drop += [z for z, _, _ in children[y]]
            chosen.add(c)
            return stab[c]
        return under

    for c in every:
        if c not in parent:
            worth(c)
    out = [-1] * n
    for p, (c, _) in fell.items():
        while c is not None and c not in chosen:
            c = parent.get(c)
        out[order[p]] = -1 if c is None else c
    sizes = Counter(c for c in out if c >= 0)
    numbers = {c: i for i, c in enumerate(sorted(sizes, key=lambda c: (-sizes[c], out.index(c))))}
    return [numbers.get(c, -1) for c in out]


def run(spark, x, m, k=None):
    rows = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "doc_id long, embedding array<double>").repartition(3)
    return [r.topic_id for r in density.clusters(rows, m, k).orderBy("doc_id").collect()]


def blobs(seed, sizes, dims, noise):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(rng.uniform(-8, 8, dims), rng.uniform(0.2, 0.9), (n, dims)) for n in sizes]
    return np.concatenate([*parts, rng.uniform(-12, 12, (noise, dims))])


def test_equal_to_all_pairs_on_500_vectors(spark, monkeypatch):
    monkeypatch.setattr(density, "CELL_POINTS", 60)
    x = blobs(1, (150, 120, 80, 60), 5, 90)
    want = by_hand(x, 10, 10)
    assert run(spark, x, 10) == want
    assert max(want) >= 3 and -1 in want


@pytest.mark.parametrize("seed,m,k,step", [(3, 8, 3, 30), (4, 4, 6, 500_000)])
def test_many_cells_and_steps_change_nothing(spark, monkeypatch, seed, m, k, step):
    monkeypatch.setattr(density, "CELL_POINTS", 12)
    monkeypatch.setattr(density, "STEP_EDGES", step)
    monkeypatch.setattr(density, "BLOCK_ROWS", 7)
    x = blobs(seed, (40, 30, 20), 2, 30)
    assert run(spark, x, m, k) == by_hand(x, m, k or m)


def test_copies_count_as_points(spark, monkeypatch):
    monkeypatch.setattr(density, "CELL_POINTS", 16)
    x = np.concatenate([np.repeat([[0.0, 0.0]], 60, 0), blobs(6, (40, 30), 2, 12), np.repeat([[9.0, -9.0]], 3, 0)])
    assert run(spark, x, 6) == by_hand(x, 6, 6)


def test_small_and_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, embedding array<double>")
    assert density.clusters(empty).count() == 0
    assert run(spark, [[1.0, 2.0]] * 3, 5) == [-1, -1, -1]
    nulls = spark.createDataFrame([(1, None), (2, [0.0]), (2, [0.0])], "doc_id long, embedding array<double>")
    assert [r.doc_id for r in density.clusters(nulls, 2).collect()] == [2, 2]
    # a single dense crowd separates into nothing
    assert set(run(spark, np.random.default_rng(0).uniform(0, 1, (40, 2)), 30)) == {-1}


def test_cells_hold_every_point_once():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, (500, 3)), np.zeros((200, 3))])
    splits = density.kd_splits(x, 16)
    cells = density._cells_of(x, splits)
    assert cells.min() == 0 and cells.max() < 16 and len(set(cells)) == 16 and len(set(cells[500:])) == 1
    assert density._cells_of(x, []).max() == 0


def test_only_points_whose_bound_reaches_a_box_go_to_it():
    """One outlier of a cell does not send the whole cell."""
    rng = np.random.default_rng(6)
    x = np.vstack([rng.random((50, 3)), [[4.0, 0.5, 0.5]]])
    far = rng.random((40, 3)) + [9, 0, 0]
    boxes = density.Boxes([3, 8], [x.min(0), far.min(0)], [x.max(0), far.max(0)], [51, 40])
    limits = np.append(np.full(50, 0.5), 6.0)
    sent = list(density._asks(np.arange(51), x, limits, 0, boxes, np.zeros(2), {"limits": (limits, density.pa.float64())}))
    assert [b.to_pylist() for b in sent] == [[{"cell_b": 8, "points": [50], "flat": x[50].tolist(), "limits": [6.0]}]]
    assert (boxes.from_points(x, np.array([1]))[:, 0] <= density._distances(x, far).min(1)).all()
