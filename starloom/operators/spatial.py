"""Spatial joins on the sphere as equi-joins on cells (zones) with the exact predicate as residual.

The side with extents (boxes in degrees) is exploded over the cells that it reaches, the other has one cell for each row, so
that every pair meets once at most and no join is a nested loop.  Crowded cells are split into four, again and again, so
that a cluster isn't one key.
"""

from __future__ import annotations

from functools import reduce
from math import radians, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import chord, elliptical_radius, separation, tangent_offsets
from ..sources.shared import dealt, kept

#: Degrees of a cell, and of the widest one; 360 by a cell is a whole number.
CELL, WIDEST = 0.25, 8.0
#: Rows of a cell beyond which it is split, and how often at most (into cells of 0.2 arcseconds, from the usual ones).
FULL, DEEPEST = 50_000, 12
#: Declination from which the north's bricks win.
NORTH = 32.375


def folded(ra: Column, dec: Column) -> tuple[Column, Column]:
    """The same point of the sphere with dec in [-90, 90]: a declination that goes on over a pole comes down on the other side."""
    turn = F.pmod(dec + 90.0, F.lit(360.0))
    return F.when(turn > 180.0, ra + 180.0).otherwise(ra), F.when(turn > 180.0, 270.0 - turn).otherwise(turn - 90.0)


def cell_of(df: DataFrame, ra: Column, dec: Column, cell: float = CELL) -> DataFrame:
    """Adds the cell of a position."""
    x = F.floor(F.pmod(ra, F.lit(360.0)) / cell)
    return df.withColumn("cell_y", F.floor((dec + 90.0) / cell)).withColumn("cell_x", F.pmod(x, F.lit(int(360 / cell))))


def _boxed(df: DataFrame, y0: Column, y1: Column, x0: Column, x1: Column) -> DataFrame:
    """Adds bounds in degrees; x1 - x0 may span RA 0."""
    return df.withColumns({"_y0": y0, "_y1": y1, "_x0": x0, "_x1": x1})


def _over(boxes: DataFrame, cell: float = CELL) -> DataFrame:
    """A row for each cell that a box reaches, all around once at most."""
    around = int(360 / cell)
    a, b = F.floor(F.col("_x0") / cell), F.least(F.floor(F.col("_x1") / cell), F.floor(F.col("_x0") / cell) + around - 1)
    rows = boxes.withColumn("cell_y", F.explode(F.sequence(F.floor((F.col("_y0") + 90.0) / cell), F.floor((F.col("_y1") + 90.0) / cell))))
    return rows.withColumn("cell_x", F.explode(F.transform(F.sequence(a, b), lambda c: F.pmod(c, F.lit(around)))))


def _quarters(rows: DataFrame, cell: float) -> DataFrame:
    """The rows of cells twice as wide, a row for each quarter that their boxes reach."""
    around = int(360 / cell)
    four = F.explode(F.array(*[F.struct((F.col("cell_y") * 2 + j).alias("y"), (F.col("cell_x") * 2 + i).alias("x")) for j in (0, 1) for i in (0, 1)]))
    rows = rows.withColumn("_q", four)
    first = F.floor(F.col("_x0") / cell)
    reached = F.col("_q.y").between(F.floor((F.col("_y0") + 90.0) / cell), F.floor((F.col("_y1") + 90.0) / cell)) & (F.pmod(F.col("_q.x") - first, F.lit(around)) <= F.least(F.floor(F.col("_x1") / cell) - first, F.lit(around - 1)))
    return rows.where(reached).withColumns({"cell_y": F.col("_q.y"), "cell_x": F.col("_q.x")}).drop("_q")


def leaves(points: DataFrame, boxes: DataFrame, ra: str | Column = "ra", dec: str | Column = "dec", cell: float = CELL) -> tuple[DataFrame, DataFrame]:
    """Points with their cell (cell_n, cell_y, cell_x: how often it was halved, and where it is) and boxes with the cells they reach.

    A cell with more than FULL points and boxes narrower than half of it is split, but DEEPEST times at most: rows at one
    place stay together, and are left to the split of skewed partitions.  Wider boxes aren't counted, as each would be in
    all quarters.  Only counts by cell are shuffled; the crowded cells are written, of which there are few for the rows.
    """
    ra, dec = (F.col(c) if isinstance(c, str) else c for c in (ra, dec))
    p, b = cell_of(points, ra, dec, cell), _over(boxes, cell)
    found_p, found_b, place = [], [], ["cell_y", "cell_x"]
    for n in range(DEEPEST + 1):
        narrow = b.where((F.col("_y1") - F.col("_y0") < cell / 2) & (F.col("_x1") - F.col("_x0") < cell / 2))
        crowd = p.select(*place).union(narrow.select(*place)).groupBy(*place).agg(F.count("*").alias("n")).where(F.col("n") > FULL).select(*place)
        crowd = kept(crowd, "crowded") if n < DEEPEST else None
        if crowd is None or crowd.isEmpty():
            found_p.append(p.withColumn("cell_n", F.lit(n)))
            found_b.append(b.withColumn("cell_n", F.lit(n)))
            break
        found_p.append(p.join(crowd, place, "left_anti").withColumn("cell_n", F.lit(n)))
        found_b.append(b.join(crowd, place, "left_anti").withColumn("cell_n", F.lit(n)))
        cell /= 2
        p = cell_of(p.join(crowd, place, "left_semi"), ra, dec, cell)
        b = _quarters(b.join(crowd, place, "left_semi"), cell)
    gather = lambda parts: reduce(DataFrame.unionByName, parts)
    return gather(found_p), gather(found_b)


def met(points: DataFrame, boxes: DataFrame, ra: str = "ra", dec: str = "dec", cell: float = CELL, on: tuple[str, ...] = (), sphere: bool = False) -> DataFrame:
    """Pairs of points and boxes that share a cell (and the columns of on), each once; the exact predicate is the caller's.

    sphere goes with boxes of reaching's great circles: points are looked for where they are on the sphere, else by their numbers.
    """
    p, b = leaves(points, boxes, *(folded(F.col(ra), F.col(dec)) if sphere else (ra, dec)), cell)
    return p.join(dealt(b.drop("_y0", "_y1", "_x0", "_x1")), ["cell_n", "cell_y", "cell_x", *on]).drop("cell_n", "cell_y", "cell_x")


def reaching(df: DataFrame, arcsec: Column, ra: str = "ra", dec: str = "dec", great_circle: bool = False) -> DataFrame:
    """The box in which a position within arcsec of a row's position may lie.

    East-west the reach is that of offsets scaled at the other position's declination, north-south that of the plain
    difference of declinations, which may lie beyond the poles; or both are those of great circles, for positions
    folded onto the sphere.
    """
    deg = arcsec / 3600.0 + 1e-7
    x, y = folded(F.col(ra), F.col(dec)) if great_circle else (F.col(ra), F.col(dec))
    # Degrees from the nearest pole, also of those that a declination beyond them passes, less the reach.
    left = F.abs(F.pmod(y, F.lit(180.0)) - 90.0) - deg
    wide = F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.least(deg, F.lit(90.0)))) / F.cos(F.radians(y)))) if great_circle else F.radians(deg) / F.sin(F.radians(left))
    half = F.when(left <= 0.1, F.lit(180.0)).otherwise(F.least(F.lit(180.0), F.degrees(wide) + 1e-7))
    low, high = (F.greatest(y - deg, F.lit(-90.0)), F.least(y + deg, F.lit(90.0))) if great_circle else (y - deg, y + deg)
    return _boxed(df, low, high, x - half, x + half)


def brick_hits(positions: DataFrame, bricks: DataFrame, min_nexp: int = 1) -> DataFrame:
    """Positions (id, ra, dec) in each hemisphere's bricks that are exposed in all bands, the nearest centre first: id, hemisphere, brick, brick_dec."""
    good = bricks.where(" and ".join(f"nexp_{b} >= {min_nexp}" for b in "grz"))
    end = F.col("ra1") + F.pmod(F.col("ra2") - F.col("ra1") + 360.0, F.lit(360.0))
    boxes = _boxed(good, F.col("dec1"), F.col("dec2"), F.col("ra1"), end).select("_y0", "_y1", "_x0", "_x1", "hemisphere", "brickname", "ra1", "ra2", "dec1", "dec2", F.col("ra").alias("bra"), F.col("dec").alias("bdec"))
    inside = (F.pmod(F.col("ra") - F.col("ra1") + 360.0, F.lit(360.0)) <= F.pmod(F.col("ra2") - F.col("ra1") + 360.0, F.lit(360.0))) & F.col("dec").between(F.col("dec1"), F.col("dec2"))
    hits = met(positions.select("id", "ra", "dec"), boxes).where(inside)
    far = F.round(chord(F.col("ra"), F.col("dec"), F.col("bra"), F.col("bdec")), 12)
    first = F.row_number().over(W.partitionBy("id", "hemisphere").orderBy(far, "brickname"))
    return hits.withColumn("rank", first).where("rank = 1").select("id", "hemisphere", F.col("brickname").alias("brick"), F.col("bdec").alias("brick_dec"))


def resolve_bricks(positions: DataFrame, bricks: DataFrame, min_nexp: int = 1) -> DataFrame:
    """id, brick and hemisphere of the positions in the footprint: the south's brick, unless the north has one that lies
    from NORTH on or the south has none."""
    hits = brick_hits(positions, bricks, min_nexp)
    side = {h: F.max(F.when(F.col("hemisphere") == h, F.struct("brick", "brick_dec"))) for h in ("south", "north")}
    both = hits.groupBy("id").agg(*(x.alias(h) for h, x in side.items()))
    north = F.col("north").isNotNull() & ((F.col("north.brick_dec") >= NORTH) | F.col("south").isNull())
    return both.select("id", F.when(north, F.col("north.brick")).otherwise(F.col("south.brick")).alias("brick"), F.when(north, "north").otherwise("south").alias("hemisphere"))


def blocked(positions: DataFrame, atlas: DataFrame, margin: float = 1.5) -> DataFrame:
    """Ids of positions (id, ra, dec, extra, exclude) that some galaxy other than exclude comes close to: within margin * r26 + extra
    of it, and so in its elliptical metric too, where extra is worth extra / ba.

    The atlas (sga_id, ra, dec, r26, ba, pa) reaches as far as its own margin plus the largest extra.
    """
    most = positions.agg(F.coalesce(F.max("extra"), F.lit(0.0))).scalar()
    near = reaching(atlas.select("sga_id", F.col("ra").alias("gra"), F.col("dec").alias("gdec"), "r26", "ba", "pa", (F.col("r26") * margin + most).alias("reach")), F.col("reach"), "gra", "gdec").drop("reach")
    east, north = tangent_offsets(F.col("ra"), F.col("dec"), F.col("gra"), F.col("gdec"), F.col("dec"))
    reach = F.col("r26") * margin
    close = (elliptical_radius(east, north, F.col("pa"), F.col("ba")) <= reach + F.col("extra") / F.col("ba")) & (F.hypot(east, north) <= reach + F.col("extra"))
    pairs = met(positions.select("id", "ra", "dec", "extra", "exclude"), near)
    return pairs.where((F.col("sga_id") != F.col("exclude")) & close).select("id").distinct()


def clear_of(positions: DataFrame, atlas: DataFrame, margin: float = 1.5) -> DataFrame:
    """The positions that no galaxy comes close to."""
    return positions.join(dealt(blocked(positions, atlas, margin)), "id", "left_anti")


def overlapping(positions: DataFrame, atlas: DataFrame, margin: float = 1.0) -> DataFrame:
    """(id, sga_id, sep): galaxies whose margin * r26 circle may reach the stamp (half_diag) at a position."""
    most = positions.agg(F.coalesce(F.max("half_diag"), F.lit(0.0))).scalar()
    near = reaching(atlas.select("sga_id", F.col("ra").alias("gra"), F.col("dec").alias("gdec"), "r26", (F.col("r26") * margin + most).alias("reach")), F.col("reach"), "gra", "gdec", True)
    sep = separation(F.col("ra"), F.col("dec"), F.col("gra"), F.col("gdec"))
    pairs = met(positions.select("id", "ra", "dec", "half_diag"), near, sphere=True).withColumn("sep", sep)
    return pairs.where(F.col("sep") <= F.col("r26") * margin + F.col("half_diag")).select("id", "sga_id", "sep")


def neighbours(positions: DataFrame, others: DataFrame, arcsec: float) -> DataFrame:
    """(id, other, chord): others (other, ra, dec) within so many arcseconds, by the chord between unit vectors."""
    near = reaching(others.select("other", F.col("ra").alias("ora"), F.col("dec").alias("odec")), F.lit(arcsec), "ora", "odec", True)
    far = chord(F.col("ra"), F.col("dec"), F.col("ora"), F.col("odec"))
    pairs = met(positions.select("id", "ra", "dec"), near, sphere=True).withColumn("chord", far)
    return pairs.where(F.col("chord") <= 2 * sin(radians(arcsec / 3600.0) / 2)).select("id", "other", "chord")


def farthest_corner(bricks: DataFrame) -> float:
    """Degrees from a brick's centre beyond which no brick of the table reaches."""
    half = F.hypot(F.pmod(F.col("ra2") - F.col("ra1") + 360.0, F.lit(360.0)) / 2, (F.col("dec2") - F.col("dec1")) / 2)
    return bricks.agg(F.coalesce(F.max(half), F.lit(0.0))).head()[0]


def nearest_centre(positions: DataFrame, bricks: DataFrame, within: float = 0.5, at_most: float = 180.0) -> DataFrame:
    """The nearest brick of each hemisphere for each position (id, ra, dec), however far it is; names settle ties.

    Bricks within some degrees are looked at first, which settles all positions that have one there, since none beyond is
    nearer.  The others go on with twice the radius, on cells twice as wide, until each has its brick, or until the radius
    is at_most: who only asks which brick holds a position has no use for bricks beyond farthest_corner.
    """
    b = bricks.select("hemisphere", "brickname", "ra1", "ra2", "dec1", "dec2", "nexp_g", "nexp_r", "nexp_z", F.col("ra").alias("bra"), F.col("dec").alias("bdec"))
    sides = [r.hemisphere for r in b.select("hemisphere").distinct().collect()]  # two at most
    here = ["id", "ra", "dec", "hemisphere"]
    left = kept(positions.select("id", "ra", "dec", F.explode(F.array(*[F.lit(h) for h in sides]).cast("array<string>")).alias("hemisphere")), "positions")
    found, cell = None, CELL
    while True:
        near = reaching(b, F.lit(within * 3600.0), "bra", "bdec", True)
        far = chord(F.col("ra"), F.col("dec"), F.col("bra"), F.col("bdec"))
        pairs = met(left, near, cell=cell, on=("hemisphere",), sphere=True).withColumn("_far", far)
        pairs = pairs.where(F.col("_far") <= 2 * sin(radians(min(within, 180.0)) / 2) + (1e-9 if within >= 180.0 else 0.0))
        rest = [c for c in b.columns if c not in ("hemisphere", "brickname")]
        best = pairs.groupBy(*here).agg(F.min(F.struct(F.round("_far", 12).alias("_far"), "brickname", *rest)).alias("b")).select(*here, "b.*").drop("_far")
        best = kept(best, "nearest")
        found = best if found is None else found.union(best)
        left = kept(left.join(dealt(best.select("id", "hemisphere")), ["id", "hemisphere"], "left_anti").select(here), "positions")
        if within >= min(at_most, 180.0) or left.isEmpty():
            return found
        within, cell = within * 2, min(cell * 2, WIDEST)
