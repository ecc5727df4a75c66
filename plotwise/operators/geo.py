"""Points, cells and polygons: cell numbers, containment and neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwise.functions.numbers import as_col
from plotwise.session import stored


@dataclass(frozen=True)
class Grid:
    """A regular lon/lat grid; cell numbers run along x from the lower left."""

    x0: float
    y0: float
    res: float
    nx: int

    def col_at(self, x) -> Column:
        return F.floor((as_col(x) - F.lit(self.x0)) / F.lit(self.res))

    def row_at(self, y) -> Column:
        return F.floor((as_col(y) - F.lit(self.y0)) / F.lit(self.res))

    def number(self, col: Column, row: Column) -> Column:
        """Cell number, NULL outside the columns of the grid."""
        return F.when((col >= 0) & (col < self.nx) & (row >= 0), row * self.nx + col)

    def cell(self, x, y) -> Column:
        return self.number(self.col_at(x), self.row_at(y))

    def col_of(self, cell) -> Column:
        return F.pmod(as_col(cell), F.lit(self.nx).cast("long"))

    def row_of(self, cell) -> Column:
        return F.floor(as_col(cell) / self.nx)

    def centre_x(self, cell) -> Column:
        return F.lit(self.x0) + (self.col_of(cell) + 0.5) * F.lit(self.res)

    def centre_y(self, cell) -> Column:
        return F.lit(self.y0) + (self.row_of(cell) + 0.5) * F.lit(self.res)

    def coarser(self, k: int) -> Grid:
        return Grid(self.x0, self.y0, self.res * k, -(-self.nx // k))


def cell_of(df: DataFrame, grid: Grid, x: str = "x", y: str = "y", out: str = "cell_id") -> DataFrame:
    return df.withColumn(out, grid.cell(x, y))


def extract_at(points: DataFrame, cells: DataFrame, grid: Grid, cols: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Values of the cell under each point; NULL where there is no cell."""
    keyed = points.withColumn("_cell", grid.cell(x, y))
    layer = cells.select(F.col("cell_id").alias("_cell"), *cols)
    return keyed.join(layer, "_cell", "left").drop("_cell")


# polygons ---------------------------------------------------------------------
def rectangle(x0, x1, y0, y1) -> Column:
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    a, b, c, d = (as_col(v) for v in (x0, x1, y0, y1))
    return F.array(corner(a, c), corner(b, c), corner(b, d), corner(a, d))


def edges_of(rings: Column) -> Column:
    """The edges of closed rings; a ring's last point leads back to its first."""

    def of(ring):
        n = F.size(ring)
        following = F.concat(F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(ring, F.lit(1), F.lit(1)))
        return F.zip_with(ring, following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    return F.flatten(F.transform(rings, of))


def odd_crossings(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd ray casting; left and lower edges belong to the polygon, holes don't."""

    def crosses(edge):
        a, b = edge["a"], edge["b"]
        straddles = (a["y"] > y) != (b["y"] > y)
        at = F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"]
        return straddles & (x < at)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def polygon_strips(polygons: DataFrame, size: float, keep: list[str]) -> DataFrame:
    """Per polygon and horizontal strip: its edges there, and the range of x that they span.

    `ring` is one ring of points or an array of rings (islands and holes). Only an edge that leads into
    another strip is there twice, and level edges are left out, so what is shipped follows the border, not the area.
    """
    ring = F.col("ring")
    many = dict(polygons.dtypes)["ring"].startswith("array<array")
    edges = edges_of(ring if many else F.array(ring))
    sides = polygons.select(*keep, F.explode(edges).alias("e")).where("e.a.y <> e.b.y")
    low, high = F.least("e.a.y", "e.b.y"), F.greatest("e.a.y", "e.b.y")
    strips = sides.withColumn("_by", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    return strips.groupBy(*keep, "_by").agg(F.collect_list("e").alias("edges"), F.min(F.least("e.a.x", "e.b.x")).alias("_xa"), F.max(F.greatest("e.a.x", "e.b.x")).alias("_xb"))


def attach_admin(points: DataFrame, polygons: DataFrame, fields: list[str], order: str, size: float = 1.0, x: str = "x", y: str = "y") -> DataFrame:
    """Fields of the polygon holding each point; lowest ``order`` on overlap.

    Distinct locations are matched once, so a place reported by many rows costs
    one test, against the edges of a polygon in the strip of the location only. Squares that a polygon's
    strip spans carry its number; its edges are one row per strip. Rows outside every polygon get NULL.
    """
    spots = points.select(F.col(x).alias("_x"), F.col(y).alias("_y")).where("_x is not null and _y is not null").distinct()
    spots = spots.withColumn("_bx", F.floor(F.col("_x") / size)).withColumn("_by", F.floor(F.col("_y") / size))
    named = polygons.select(F.col(order).alias("_order"), F.struct(*fields).alias("_fields"), "ring")
    strips = stored(polygon_strips(named, size, ["_order", "_fields"]))
    squares = strips.select("_order", "_fields", "_by", "_xa", "_xb", F.explode(F.sequence(F.floor(F.col("_xa") / size), F.floor(F.col("_xb") / size))).alias("_bx"))
    near = spots.join(squares, ["_bx", "_by"]).where(F.col("_x").between(F.col("_xa"), F.col("_xb")))
    tested = near.select("_x", "_y", "_by", "_order", "_fields").join(strips.select("_order", "_fields", "_by", "edges"), ["_order", "_fields", "_by"])
    hits = tested.where(odd_crossings(F.col("edges"), F.col("_x"), F.col("_y")))
    first = hits.groupBy("_x", "_y").agg(F.min_by("_fields", "_order").alias("_fields"))
    return (
        points.join(first, (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y")), "left")
        .select(*points.columns, *[F.col(f"_fields.{f}").alias(f) for f in fields])
    )


# neighbours ----------------------------------------------------------------------
def knn(points: DataFrame, k: int, key: str = "point_id", x: str = "x", y: str = "y", levels: int = 16) -> DataFrame:
    """The k nearest other points: (key, neighbour, rank, dist), exact.

    Ties in distance go to the lower key.  Three bounds keep the work linear
    for any spread of points:

    * rows at one location share a neighbour list, and only the k + 1 lowest
      keys of a location can appear in one;
    * space is halved ``levels`` times; a location searches at the finest level
      where its own square holds k + 1 candidates.  Those lie within sqrt(2)
      sides, so the answer is in the 21 squares around it (5 x 5 less corners);
    * per square, fewer than 4 (k + 1) candidates of *other* squares search at
      a level coarser than their own, so a crowded square is read by few.
    """
    known = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("_id"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    width = F.greatest(F.max("_x") - F.min("_x"), F.max("_y") - F.min("_y"), F.lit(1e-9)) * (1 + 1e-9)
    box = known.agg(F.struct(F.min("_x").alias("x0"), F.min("_y").alias("y0"), width.alias("w"))).scalar()
    per_spot = Window.partitionBy("_x", "_y").orderBy("_id")
    candidates = known.withColumn("_rn", F.row_number().over(per_spot)).where(F.col("_rn") <= k + 1)

    def tiles(df: DataFrame, level) -> DataFrame:
        df = df.withColumn("_box", box).withColumn("_level", level)
        side = F.pow(F.lit(2.0), F.col("_level"))
        return df.select(
            *[c for c in df.columns if c not in ("_box", "_rn")],
            F.floor((F.col("_x") - F.col("_box.x0")) / F.col("_box.w") * side).alias("_i"),
            F.floor((F.col("_y") - F.col("_box.y0")) / F.col("_box.w") * side).alias("_j"),
        )

    every = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    sites = tiles(candidates, every)
    busy = sites.groupBy("_level", "_i", "_j").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > k).drop("_n")
    # a location is represented by its lowest candidate
    firsts = sites.join(candidates.where("_rn = 1").select("_id"), "_id", "left_semi")
    spots = candidates.where("_rn = 1").select("_x", "_y")
    chosen = firsts.join(busy, ["_level", "_i", "_j"]).groupBy("_x", "_y").agg(F.max("_level").alias("_best"))
    placed = spots.join(chosen, ["_x", "_y"], "left")
    home = tiles(placed, F.coalesce("_best", F.lit(0))).withColumnsRenamed({"_x": "_qx", "_y": "_qy"})
    steps = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if abs(a) + abs(b) < 4]
    around = home.withColumn("_d", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps])))
    asked = around.select("_qx", "_qy", "_level", (F.col("_i") + F.col("_d.a")).alias("_i"), (F.col("_j") + F.col("_d.b")).alias("_j"))
    dx, dy = F.col("_x") - F.col("_qx"), F.col("_y") - F.col("_qy")
    pairs = asked.join(sites, ["_level", "_i", "_j"]).select("_qx", "_qy", "_id", (dx * dx + dy * dy).alias("_d2"))
    nearest = Window.partitionBy("_qx", "_qy").orderBy("_d2", "_id")
    best = pairs.withColumn("_rn", F.row_number().over(nearest)).where(F.col("_rn") <= k + 1)
    lists = best.groupBy("_qx", "_qy").agg(F.sort_array(F.collect_list(F.struct("_d2", "_id"))).alias("_near"))
    joined = known.join(lists, (F.col("_x") == F.col("_qx")) & (F.col("_y") == F.col("_qy")))
    mine = F.slice(F.filter("_near", lambda e: e["_id"] != F.col("_id")), 1, k)
    return joined.select(F.col("_id").alias(key), F.posexplode(mine).alias("_p", "_e")).select(
        key, F.col("_e._id").alias("neighbour"), (F.col("_p") + 1).alias("rank"), F.sqrt("_e._d2").alias("dist")
    )


def nearest_cell(points: DataFrame, cells: DataFrame, grid: Grid, key: str, rings: int = 2, x: str = "x", y: str = "y") -> DataFrame:
    """The nearest present cell centre of a regular grid per point: (key, cell_id, dist).

    Each distinct location looks at the cells within ``rings``; those whose
    nearest find is not certain go down a pyramid of occupied squares, from the
    whole grid to single cells, keeping the squares that may hold the nearest.
    """
    spots = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_x"), F.col(y).alias("_y")).distinct()
    present = cells.select("cell_id", grid.col_of("cell_id").alias("_i"), grid.row_of("cell_id").alias("_j")).distinct()
    around = F.explode(F.sequence(F.lit(-rings), F.lit(rings)))
    home = spots.withColumns({"_hi": grid.col_at("_x"), "_hj": grid.row_at("_y")}).withColumn("_a", around).withColumn("_b", around)
    asked = home.withColumns({"_i": F.col("_hi") + F.col("_a"), "_j": F.col("_hj") + F.col("_b")})
    dist = _distance(F.col("_x") - grid.centre_x("cell_id"), F.col("_y") - grid.centre_y("cell_id"))
    near = asked.join(present, ["_i", "_j"]).groupBy("_x", "_y").agg(F.min(F.struct(dist.alias("_d"), "cell_id")).alias("_e"))
    # a cell that wasn't asked is more than rings + 1/2 cells away along x or y
    round_ = stored(spots.join(near, ["_x", "_y"], "left").withColumn("_sure", F.coalesce(F.col("_e._d") < (rings + 0.5) * grid.res * (1 - 1e-9), F.lit(False))))
    found = round_.where("_sure").select("_x", "_y", "_e")
    rest = round_.where("not _sure").select("_x", "_y")
    if not rest.isEmpty():
        for last in descents(rest, present, grid):
            pass
        found = found.unionByName(last.groupBy("_x", "_y").agg(F.min(F.struct(F.col("_low").alias("_d"), "cell_id")).alias("_e")))
    return points.join(found, (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y"))).select(key, F.col("_e.cell_id").alias("cell_id"), F.col("_e._d").alias("dist"))


def _distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def descents(spots: DataFrame, present: DataFrame, grid: Grid) -> Iterator[DataFrame]:
    """Per step of a pyramid, the squares that may hold a location's nearest cell, the last step being single cells.

    Steps go four times finer, so there are half the binary digits of the extent.
    A square is kept where its nearest centre could lie no farther than the
    farthest one of another square of the same location.
    """
    extent = present.agg(F.min("_i"), F.max("_i"), F.min("_j"), F.max("_j")).first()
    if extent[0] is None:
        yield spots.select("_x", "_y", F.lit(0.0).alias("_low"), F.lit(None).cast("long").alias("cell_id")).limit(0)
        return
    steps = -(-max(extent[1] - extent[0], extent[3] - extent[2], 1).bit_length() // 2)
    open_squares = spots.withColumns({"_pi": F.lit(0).cast("long"), "_pj": F.lit(0).cast("long")})
    for step in range(steps - 1, -1, -1):
        shift, span = 2 * step, (1 << 2 * step) - 1
        at = {c: F.shiftright(F.col(c) - F.lit(low).cast("long"), shift) for c, low in (("_i", extent[0]), ("_j", extent[2]))}
        squares = present.select(at["_i"].alias("_si"), at["_j"].alias("_sj"), *(["cell_id"] if step == 0 else [])).distinct()
        squares = squares.withColumns({"_pi": F.shiftright("_si", 2), "_pj": F.shiftright("_sj", 2)})
        met = open_squares.join(squares, ["_pi", "_pj"])
        ends = {}
        for c, s, low, first in (("x", "_si", extent[0], grid.x0), ("y", "_sj", extent[2], grid.y0)):
            a = F.lit(first) + (F.shiftleft(s, shift) + F.lit(low).cast("long") + 0.5) * F.lit(grid.res)
            ends[c] = (a, a + F.lit(span * grid.res))
        gaps, farthest = [], []
        for c, (a, b) in ends.items():
            v = F.col(f"_{c}")
            gaps.append(F.greatest(a - v, v - b, F.lit(0.0)))
            farthest.append(F.greatest(F.abs(v - a), F.abs(v - b)))
        low = _distance(*gaps) if step else _distance(F.col("_x") - grid.centre_x("cell_id"), F.col("_y") - grid.centre_y("cell_id"))
        met = met.withColumns({"_low": low, "_high": _distance(*farthest)})
        best = met.groupBy("_x", "_y").agg(F.min("_high").alias("_best"))
        kept = met.join(best, ["_x", "_y"]).where(F.col("_low") <= F.col("_best") * (1 + 1e-9) + 1e-12)
        open_squares = stored(kept.select("_x", "_y", F.col("_si").alias("_pi"), F.col("_sj").alias("_pj"), "_low", *(["cell_id"] if step == 0 else [])))
        yield open_squares
        open_squares = open_squares.drop("_low")
