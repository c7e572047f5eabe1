"""Cover trees against all pairs, and queries against their SQL."""

from __future__ import annotations

from collections import Counter

import numpy as np
import oracle
import pytest
from conftest import DATA
from llm import brute

from stallwise.llm import covertree
from stallwise.llm.queries import QUERIES, SQL


def _vectors(seed: int, n: int) -> np.ndarray:
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(8, 12))
    x = centres[draw.integers(0, 8, n)] + draw.normal(scale=draw.choice([0.01, 0.2, 0.4, 1.5], (n, 1)), size=(n, 12))
    return np.concatenate([x, x[:5], x[:3] * 2.5]).astype(np.float32)


def _expected(x: np.ndarray, label: list, cosine: float) -> list[tuple[int, int]]:
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= cosine
    same = np.array([[a == b and a is not None for b in label] for a in label])
    np.fill_diagonal(near, False)
    return [(int(i), int(j)) for i, j in zip(*np.nonzero(near & same))]


@pytest.mark.parametrize("split", [False, True])
def test_trees_find_all_links(split):
    x = _vectors(3, 400).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    weight = np.random.default_rng(4).integers(1, 4, len(x))
    side = np.random.default_rng(5).integers(0, 2, len(x)) if split else np.zeros(len(x), int)
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    if split:
        near &= side[:, None] != side[None, :]
    links = covertree.linked(x, weight, side, 0.93)
    assert (links.count == near @ weight).all()
    group = brute.groups(len(x), zip(*map(list, np.nonzero(near))))
    assert len(set(zip(group, links.root.tolist()))) == len(set(group)) == len(set(links.root.tolist()))


@pytest.mark.parametrize("block", [2000, 40])
def test_links_of_a_table(spark, monkeypatch, block):
    monkeypatch.setattr(covertree, "BLOCK", block)
    x = _vectors(7, 300)
    label = [None if i % 29 == 0 else int(i % 7 > 2) for i in range(len(x))]
    rows = [(i, v.tolist(), lab) for i, (v, lab) in enumerate(zip(x, label))]
    n = len(rows)
    odd = [None, [], [0.0] * 12, [float("nan")] + [1.0] * 11, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11, [1.0] * 5]
    rows += [(n + i, v, 1) for i, v in enumerate(odd)]
    links = _expected(x, label, 0.93)
    group = brute.groups(len(rows), links)
    degree = Counter(a for a, _ in links)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    found = {r.vec_id: tuple(r)[1:] for r in covertree.vector_links(df, 0.93).collect()}
    assert found == {i: (degree[i], group[i], group[i] == i) for i in range(len(rows))}


def _units(spark, x: np.ndarray):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    rows = [("a", x.shape[1] * 8, i, 1, bytearray(v.tobytes())) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "label string, bytes int, rep long, weight long, unit binary")


def test_cells_nest_and_drop_pairs(spark, monkeypatch):
    """Every point lies in one leaf, every link in a pair of leaves that is kept, and most pairs are not."""
    monkeypatch.setattr(covertree, "BLOCK", 10)  # less than a cluster, so that most leaves lie within one
    monkeypatch.setattr(covertree, "FAN", 4)
    draw = np.random.default_rng(8)
    clusters = draw.normal(size=(40, 16))
    x, points = _units(spark, np.repeat(clusters, 20, 0) + draw.normal(scale=0.05, size=(800, 16)))
    placed, tree = covertree.cells_of(covertree.cut(points))
    cell = {r.rep: r.cell for r in placed.collect()}
    leaves = {r.cell: r.size for r in tree.filter("not inner").collect()}
    assert sorted(cell) == list(range(800)) and Counter(cell.values()) == Counter(leaves)
    assert tree.filter("inner and size <= 10").isEmpty() and max(c.count(".") for c in leaves) > 2
    limit = (2 - 2 * 0.93) ** 0.5
    pairs = [(r.a, r.b) for r in covertree.near_cells(tree, limit).collect()]
    assert len(pairs) == len(set(pairs)) == len({frozenset(p) for p in pairs})
    held = {frozenset(p) for p in pairs}
    linked = zip(*np.nonzero(x @ x.T >= 0.93))
    assert all(frozenset((cell[i], cell[j])) in held for i, j in linked)
    assert len(pairs) < len(leaves) * (len(leaves) + 1) / 2 / 4


def test_cells_that_do_not_part(spark, monkeypatch):
    """Points too alike for more levels share a cell of several blocks, and none is lost."""
    monkeypatch.setattr(covertree, "BLOCK", 10)
    monkeypatch.setattr(covertree, "LEVELS", 1)
    monkeypatch.setattr(covertree, "FAN", 2)
    x = np.ones((120, 6)) + np.random.default_rng(9).normal(scale=1e-6, size=(120, 6))
    df = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    assert {tuple(r) for r in covertree.vector_links(df).collect()} == {(i, 119, 0, i == 0) for i in range(120)}


def test_repeated_rows_link(spark):
    rows = [(4, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (9, [1.0, 2.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = Counter(tuple(r) for r in covertree.vector_links(df).collect())
    assert found == Counter({(4, 2, 4, True): 2, (None, 2, 4, False): 1, (9, 0, 9, True): 1})


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    folder = f"{DATA}/sf0.01"
    diff, rows = oracle.difference(QUERIES[name](spark, folder), oracle.connect(folder), SQL[name])
    assert diff is None and rows > 0
