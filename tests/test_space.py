"""Neighbours, polygons and fuzzy names against brute force."""

import numpy as np

from plotwise.functions.text import _jaro
from plotwise.operators import geo as G
from plotwise.operators import joins as J


def brute_knn(pts, k):
    out = set()
    for i, x, y in pts:
        near = sorted(((px - x) ** 2 + (py - y) ** 2, j) for j, px, py in pts if j != i)[:k]
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(near)}
    return out


def test_knn_with_hot_spot_and_far_points(spark):
    rng = np.random.default_rng(3)
    pts = [(i, 5.0, 5.0) for i in range(60)]  # a third of the points at one place
    pts += [(100 + i, 5.0 + float(a), 5.0 + float(b)) for i, (a, b) in enumerate(rng.normal(0, 0.01, (60, 2)))]
    pts += [(200 + i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-40, 40, (60, 2)))]
    df = spark.createDataFrame(pts, "point_id int, x double, y double")
    got = {(r[0], r[1], r[2]) for r in G.knn(df, 4).collect()}
    assert got == brute_knn(pts, 4)


def test_knn_with_fewer_points_than_k(spark):
    pts = [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 9.0, 9.0)]
    df = spark.createDataFrame(pts, "point_id int, x double, y double")
    assert {(r[0], r[1], r[2]) for r in G.knn(df, 4).collect()} == brute_knn(pts, 4)


def test_nearest_cell_over_a_gap(spark):
    grid = G.Grid(0.0, 0.0, 1.0, 40)
    cells = spark.createDataFrame([(0,), (39,), (40 * 30 + 20,)], "cell_id long")
    pts = spark.createDataFrame([(1, 0.9, 0.9), (2, 18.0, 1.0), (3, 21.0, 29.0), (4, -3.0, 50.0)], "point_id int, x double, y double")
    centres = {0: (0.5, 0.5), 39: (39.5, 0.5), 1220: (20.5, 30.5)}
    got = {r.point_id: r.cell_id for r in G.nearest_cell(pts, cells, grid, "point_id").collect()}
    for p, x, y in [(1, 0.9, 0.9), (2, 18.0, 1.0), (3, 21.0, 29.0), (4, -3.0, 50.0)]:
        assert got[p] == min(centres, key=lambda c: (centres[c][0] - x) ** 2 + (centres[c][1] - y) ** 2)


def test_polygon_with_notch_and_overlap(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    polys = spark.createDataFrame([(2, "notch", [dict(x=x, y=y) for x, y in ring]), (1, "box", [dict(x=x, y=y) for x, y in [(3.0, 0.0), (6.0, 0.0), (6.0, 2.0), (3.0, 2.0)]])], "rank int, name string, ring array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 3.0), (3, 3.5, 1.0), (4, 9.0, 9.0), (5, None, 1.0)], "id int, x double, y double")
    got = {r.id: r.name for r in G.attach_admin(pts, polys, ["name"], "rank").collect()}
    assert got == {1: "notch", 2: None, 3: "box", 4: None, 5: None}


def test_fuzzy_join_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    letters = list("abcde ")
    words = lambda n: [("".join(rng.choice(letters, rng.integers(0, 9)))) for _ in range(n)]
    a, b = words(60), words(60) + ["Abcd", "ABC d"]
    left = spark.createDataFrame([(i, w) for i, w in enumerate(a)], "i int, name string")
    right = spark.createDataFrame([(j, w) for j, w in enumerate(b)], "j int, name string")
    got = {(r.i, r.j) for r in J.fuzzy_join(left, right, ["name"], 0.2).collect()}
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if _jaro(x.lower(), y.lower()) >= 0.8 - 1e-12}
    assert got == want


def test_token_veto(spark):
    df = spark.createDataFrame([("north bank", "north bank"), ("north bank", "bank"), ("bank", "north bank")], "a string, b string")
    assert J.veto_tokens(df, "a", "b", ["North"]).count() == 2
