"""Embedding near-dedup by lattice hashing against brute force."""

from collections import Counter

import numpy as np
import pytest

from pitspark.llm import lattice
from test_filters import rows

DDL = "vec_id long, embedding array<float>, label int, node long, copies int, bands string, v string, digest string"
COLUMNS = ["vec_id", "n_links", "component_id", "kept"]


def frame(spark, table):
    return spark.createDataFrame([(i, v, 1, 2, 3, "x", "y", "z") for i, v in table], DDL)


def plain(table, threshold=0.95):
    def usable(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    vectors = [np.array(v, np.float32).astype(float) if usable(v) else None for _, v in table]
    n = len(table)
    linked = np.zeros((n, n), bool)
    for width in {len(v) for v in vectors if v is not None}:
        at = [i for i, v in enumerate(vectors) if v is not None and len(v) == width]
        x = np.array([vectors[i] / np.linalg.norm(vectors[i]) for i in at])
        linked[np.ix_(at, at)] = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    root = list(range(n))
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(linked[todo.pop()]):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root[i] = min((table[j][0] for j in seen if table[j][0] is not None), default=None)
    return Counter((table[i][0], int(linked[i].sum()), root[i], table[i][0] == root[i]) for i in range(n))


def around(rng, center, cosine):
    z = rng.standard_normal(len(center))
    z -= z @ center * center
    return cosine * center + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


def planted(seed, width=64):
    rng = np.random.default_rng(seed)
    unit = rng.standard_normal((40, width))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    table = [(i, (u * rng.uniform(0.01, 100)).tolist()) for i, u in enumerate(unit)]
    table += [(100 + i, around(rng, u, c).tolist()) for i, (u, c) in enumerate(zip(unit, np.linspace(0.952, 0.9999, 40)))]
    table += [(200 + i, around(rng, u, 0.94).tolist()) for i, u in enumerate(unit[:10])]
    step = unit[0]
    for i in range(12):  # a chain that only links neighbours
        step = around(rng, step, 0.96)
        table.append((300 + i, step.tolist()))
    return table + [(400 + i, around(rng, unit[3], 0.99).tolist()) for i in range(60)]


def awkward():
    return [
        (1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [2.0, -1.0]), (2, [10.0, 20.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]),
        (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 2.1]), (None, [-5.0, 1.0]), (9, [3.0]), (10, [0.5]), (11, [-1.0]),
        (12, [1e-38, 2e-38]), (13, [1e38, 2e38]), (14, [0.0, 1.0]), (15, [-0.0, 1.0]),
    ]


@pytest.mark.parametrize("block", [2048, 7])
def test_links_equal_brute_force(spark, block):
    table = planted(5) + [(500 + i, v) for i, v in awkward() if i is not None] + awkward()
    got = lattice.embedding_duplicates(frame(spark, table), block_vectors=block)
    assert rows(got, *COLUMNS) == plain(table)


def test_many_copies_and_no_rows(spark):
    table = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(1000, [1.0, 2.0, 3.1]), (1001, [3.0, 2.0, 1.0])]
    assert rows(lattice.embedding_duplicates(frame(spark, table)), *COLUMNS) == plain(table)
    assert lattice.embedding_duplicates(frame(spark, []).limit(0)).count() == 0
    assert rows(lattice.embedding_duplicates(frame(spark, [(1, None)])), *COLUMNS) == Counter([(1, 0, 1, True)])


@pytest.mark.parametrize("rows_in", [100, 10**6, 10**9])
def test_tables_reach_the_recall_at_the_threshold(rows_in):
    tables, lattices, scale, probes = lattice.choose_tables(rows_in, 0.95, 0.99)
    assert tables >= 2
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 48))
    base /= np.linalg.norm(base, axis=1)[:, None]
    other = np.array([around(rng, u, 0.95) for u in base])
    hasher = lattice.CellHasher(tables, lattices, scale, probes, 5)
    a, b = hasher(base), hasher(other)
    assert np.mean([len(np.intersect1d(x, y)) > 0 for x, y in zip(a, b)]) >= 0.97


def test_nearest_points_of_the_lattice():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8)) * 2
    own = lattice.nearest_e8(x)
    assert len(np.unique(lattice.least_vectors(), axis=0)) == 240
    near = own[:, None, :] + lattice.least_vectors()[None]
    assert (((x[:, None, :] - near) ** 2).sum(2) >= ((x - own) ** 2).sum(1)[:, None] - 1e-9).all()
    assert (np.abs(x - own) ** 2).sum(1).max() <= 1 + 1e-9  # covering radius
