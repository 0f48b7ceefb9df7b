import numpy as np
import pytest

from waymill.llm import lattice

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, least=0.95):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root = {i: i for i, _ in rows if i is not None}
    links = dict.fromkeys(root, 0)
    pairs = [(i, j) for a, (i, x) in enumerate(good) for j, y in good[a + 1 :] if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least]
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            m = min(root[i], root[j])
            if root[i] != m or root[j] != m:
                root[i] = root[j] = m
                changed = True
    return {i: (links[i], root[i], root[i] == i) for i in root}, len(pairs)


def vectors(seed=0, n=300, spread=0.025):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        v = rng.normal(size=64)
        v /= np.linalg.norm(v)
        out.append(v)
        for _ in range(int(rng.integers(0, 4))):
            out.append((v + rng.normal(size=64) * spread) * rng.uniform(0.5, 2))
    return [np.float32(v).tolist() for v in out]


@pytest.mark.parametrize("block", [4096, 3])
def test_matches_brute_force(spark, block):
    v = vectors()
    v += [v[0], v[0], None, [], [0.0] * 64, [float("nan")] + v[1][1:], [None] + v[1][1:], v[1][:32], [float("inf")] * 64]
    rows = [(i, x, 0, "x") for i, x in enumerate(v)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block).collect()}
    want, _ = brute([r[:2] for r in rows])
    assert got == want


def test_recall_near_the_threshold(spark):
    """Pairs of cosine 0.95 to 0.98 are found nine times in ten, and nothing below 0.95 is."""
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(400):
        v, w = rng.normal(size=(2, 64))
        v /= np.linalg.norm(v)
        w -= (w @ v) * v
        w /= np.linalg.norm(w)
        c = rng.uniform(0.93, 0.98)
        rows += [(len(rows), v.tolist(), 0, ""), (len(rows) + 1, (c * v + np.sqrt(1 - c * c) * w).tolist(), 0, "")]
    got = {r.vec_id: r.n_links for r in lattice.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    want, pairs = brute([(i, np.float32(v).tolist()) for i, v, _, _ in rows])
    assert all(got[i] <= want[i][0] for i in got)
    assert sum(got.values()) / 2 >= 0.9 * pairs


def test_odd_tables(spark):
    assert lattice.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, [1.0, 0.0], 0, ""), (1, [1.0, 0.0], 0, ""), (None, [1.0, 0.0], 0, ""), (2, [1.0, 0.01], 0, "")]
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in lattice.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-1, 0, -1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8)) * 2
    best = lattice.nearest_e8(x)
    d = ((x - best) ** 2).sum(axis=1)
    assert (d <= 1 + 1e-9).all()  # the covering radius
    for step in lattice.minimal_vectors():
        assert (((x - best - step) ** 2).sum(axis=1) >= d - 1e-9).all()
    assert len(lattice.minimal_vectors()) == 240


@pytest.mark.parametrize("n", [1_000, 1_000_000, 1_000_000_000])
@pytest.mark.parametrize("width", [16, 64, 384])
def test_recall_holds_as_cells_shrink(n, width):
    """Random pairs at the threshold meet in some table whatever the size of the table that cells are made for."""
    edge = lattice.edge_for(n)
    tables = lattice.tables_for(width, 0.95, lattice.PROBES, edge, 11)
    rng = np.random.default_rng(width)
    a, b = rng.normal(size=(2, 1500, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    (ha, na), (hb, nb) = lattice.cells(a, tables, lattice.PROBES, edge, 11), lattice.cells(b, tables, lattice.PROBES, edge, 11)
    met = ((ha == hb) | (na == hb[:, :, None]).any(axis=2) | (nb == ha[:, :, None]).any(axis=2)).any(axis=1)
    assert met.mean() > 0.95 and tables <= 60
    assert lattice.edge_for(1_000) > lattice.edge_for(1_000_000) > lattice.edge_for(10**9)
