"""Polygons of several rings, far cells, unit pairs and fuzzy names against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from plotwise.functions.text import _jaro
from plotwise.operators import geo as G
from plotwise.operators import joins as J


def box(x0, x1, y0, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def inside(rings, x, y):
    """Crossings of a ray to the right, over all rings."""
    n = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                n += 1
    return n % 2 == 1


def test_polygons_with_holes_and_islands(spark):
    rng = np.random.default_rng(3)
    jagged = [(float(10 + 4 * np.cos(t) * (1 + 0.4 * np.sin(9 * t))), float(3 + 4 * np.sin(t) * (1 + 0.4 * np.sin(9 * t)))) for t in np.linspace(0, 6.2, 200)]
    polygons = [
        (1, "ring", [box(0.0, 6.0, 0.0, 6.0), box(2.0, 4.0, 1.5, 4.5)]),
        (2, "islands", [box(-5.0, -4.0, 0.0, 1.0), box(-3.0, -2.5, 2.0, 3.0)]),
        (3, "jagged", [jagged]),
        (4, "wide", [box(-25.0, 25.0, -25.0, 25.0)]),
    ]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform([-27, -27], [27, 27], (400, 2)))]
    points += [(1000 + i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform([-6, -2], [16, 8], (600, 2)))]
    points += [(5000 + i, x, y) for i, (x, y) in enumerate([(2.0, 2.0), (3.0, 3.0), (4.0, 1.5), (0.0, 0.0), (6.0, 3.0), (2.0, 1.5)])] + [(6000, None, 1.0)]
    p = spark.createDataFrame(points, "id int, x double, y double")
    q = spark.createDataFrame([(o, n, [[{"x": x, "y": y} for x, y in r] for r in rings]) for o, n, rings in polygons], "ord int, name string, ring array<array<struct<x:double,y:double>>>")
    for size in (1.0, 3.7):
        found = {r.id: r.name for r in G.attach_admin(p, q, ["name"], "ord", size).collect()}
        assert len(found) == len(points) and found[6000] is None
        for i, x, y in points[:-1]:
            want = next((n for _, n, rings in polygons if inside(rings, x, y)), None)
            assert found[i] == want, (x, y)
    single = q.where("ord = 4").withColumn("ring", F.col("ring")[0])
    strips = G.polygon_strips(single, 1.0, ["ord"])
    assert strips.agg(F.sum(F.size("edges"))).first()[0] <= 2 * 51  # the border, not 2,500 squares
    assert G.attach_admin(p, single, ["name"], "ord").where("name is not null").count() == sum(inside(polygons[3][2], x, y) for _, x, y in points[:-1])


def test_far_cells_cost_few_rows(spark):
    grid = G.Grid(-10.0, -5.0, 0.5, 20_000)
    rng = np.random.default_rng(5)
    cells = sorted({int(j) * 20_000 + int(i) for i, j in rng.integers(0, 60, (150, 2))} | {9_000 * 20_000 + 12_000, 9_000 * 20_000 + 12_001})
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform([-12, -8], [30, 30], (120, 2)))]
    points += [(500, 3000.0, 1000.0), (501, 8000.0, 9000.0), (502, -4000.0, -4000.0), (503, -9.75, -4.75), (504, None, 1.0)]
    df, c = spark.createDataFrame(points, "point_id int, x double, y double"), spark.createDataFrame([(v,) for v in cells], "cell_id long")
    found = {r.point_id: r for r in G.nearest_cell(df, c, grid, "point_id").collect()}
    assert set(found) == {p[0] for p in points} - {504}
    for k, x, y in points[:-1]:
        best = min((np.hypot(-10 + (v % 20_000 + 0.5) * 0.5 - x, -5 + (v // 20_000 + 0.5) * 0.5 - y), v) for v in cells)
        assert abs(found[k].dist - best[0]) < 1e-9
    present = c.select("cell_id", grid.col_of("cell_id").alias("_i"), grid.row_of("cell_id").alias("_j"))
    far = spark.createDataFrame([(3000.0, 1000.0), (8000.0, 9000.0)], "_x double, _y double")
    assert all(step.count() <= 60 for step in G.descents(far, present, grid))
    assert G.nearest_cell(df, c.where("cell_id < 0"), grid, "point_id").count() == 0


def test_unit_pairs_in_blocks(spark):
    df = spark.range(25).select((F.col("id") % 23).alias("u")).unionByName(spark.createDataFrame([(None,)], "u long"))
    for block in (4, 1000):
        found = [(r.train_unit, r.test_unit) for r in J.unit_pairs(df, "u", block).collect()]
        assert sorted(found) == sorted((a, b) for a in range(23) for b in range(23) if a != b)


def test_few_names_are_scored(spark):
    """1,000 names in 20 regions: all close pairs are found, under 5 % of all pairs are scored."""
    dice = random.Random(7)
    syllables = ["ka", "mo", "ri", "tel", "ban", "du", "sha", "lo", "we", "zin", "pra", "gu"]
    name = lambda: "".join(dice.choice(syllables) for _ in range(dice.randrange(2, 5)))
    regions = [f"{name()}{name()}" for _ in range(20)]
    a = [(dice.choice(regions), name()) for _ in range(1000)]
    b = []
    for region, n in a:
        letters = list(n)
        if dice.random() < 0.5:
            letters[dice.randrange(len(letters))] = dice.choice("aeiou")
        b.append((region if dice.random() < 0.8 else dice.choice(regions).upper(), "".join(letters).title()))
    left, right = (spark.createDataFrame([*t, ("", ""), (None, "x")], "region string, name string") for t in (a, b))
    found = {(r.region.lower(), r.name.lower(), r.region_right.lower(), r.name_right.lower()) for r in J.fuzzy_join(left, right, ["region", "name"]).collect()}
    close = lambda x, y: _jaro(x, y) >= 0.8 - 1e-12 if x and y else x == y
    want = {(r, n, s.lower(), m.lower()) for r, n in {*a, ("", "")} for s, m in {*b, ("", "")} if close(r, s.lower()) and close(n, m.lower())}
    assert found == want and len(want) > 500
    names = lambda df: df.select(F.lower("region").alias("region"), F.lower("name").alias("s")).dropna()
    scored = J.candidate_pairs(names(left), names(right), ["region"], 0.2).count()
    assert scored < 0.05 * 1000 * 1000
