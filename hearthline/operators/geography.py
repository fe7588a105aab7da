"""Tract geometry: adjacency, nearest neighbours, area summaries.

Candidate neighbours come from shared edges and grid cells, not from all pairs of an area.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.functions.columns import county_code, state_code


def with_codes(tracts: DataFrame) -> DataFrame:
    """State, county and full code taken from the 11-digit tract id."""
    return tracts.withColumns(
        {
            "state": state_code(),
            "county": county_code(),
            "fips_code": F.concat(state_code(), county_code(), F.substring("tract_id", 6, 6)),
        }
    )


def square_tracts(tracts: DataFrame, side: float) -> DataFrame:
    """Give tracts that only have a centroid a square outline."""
    half = side / 2
    corners = [(-half, -half), (half, -half), (half, half), (-half, half), (-half, -half)]
    ring = F.array(*[F.array(F.col("centroid_x") + dx, F.col("centroid_y") + dy) for dx, dy in corners])
    return tracts.withColumn("geometry", ring)


def _segments(tracts: DataFrame) -> DataFrame:
    """(tract_id, cbsa_id, ax, ay, bx, by): every edge of every outer ring, its ends in order.

    A tract's outline is the set of its ``rings`` where the table has them, else the one of ``geometry``.
    """
    rings = F.col("rings") if "rings" in tracts.columns else F.array("geometry")
    ring = tracts.select("tract_id", "cbsa_id", F.explode(rings).alias("ring")).where(F.size("ring") > 1)
    ends = F.arrays_zip(
        F.slice("ring", 1, F.size("ring") - 1).alias("p"), F.slice("ring", 2, F.size("ring") - 1).alias("q")
    )
    edges = ring.select("tract_id", "cbsa_id", F.explode(ends).alias("e")).select(
        "tract_id", "cbsa_id", F.array_sort(F.array("e.p", "e.q")).alias("e")
    )
    return edges.select(
        "tract_id", "cbsa_id", F.col("e")[0][0].alias("ax"), F.col("e")[0][1].alias("ay"),
        F.col("e")[1][0].alias("bx"), F.col("e")[1][1].alias("by"),
    )


def segment_distance(first: str, second: str) -> Column:
    """Least distance of two segments, each four columns of a prefix; 0 where they cross."""
    a, b, c, d = ((F.col(f"{p}{e}x"), F.col(f"{p}{e}y")) for p in (first, second) for e in "ab")

    def turn(o, p, q) -> Column:
        return (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])

    def reach(p, start, end) -> Column:
        dx, dy = end[0] - start[0], end[1] - start[1]
        length = F.greatest(dx * dx + dy * dy, F.lit(1e-300))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p[0] - start[0]) * dx + (p[1] - start[1]) * dy) / length))
        return F.hypot(start[0] + t * dx - p[0], start[1] + t * dy - p[1])

    crossing = (turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)
    return F.when(crossing, 0.0).otherwise(F.least(reach(c, a, b), reach(d, a, b), reach(a, c, d), reach(b, c, d)))


def _cells(segments: DataFrame, tolerance: float) -> DataFrame:
    """Segments with every grid cell they come near: column by column, the cells between their heights there.

    Cells are twice as wide as the area's mean segment, so a segment has few cells and a cell few segments.
    """
    width = segments.groupBy("cbsa_id").agg(
        F.greatest(2 * F.avg(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))), F.lit(10 * tolerance)).alias("w")
    )
    margin = F.lit(tolerance)
    # Ends are in order, so ax <= bx.
    columns = F.sequence(F.floor((F.col("ax") - margin) / F.col("w")), F.floor((F.col("bx") + margin) / F.col("w")))
    by_column = segments.join(width, "cbsa_id").withColumn("cx", F.explode(columns))

    def height(x: Column) -> Column:
        share = F.try_divide(x - F.col("ax"), F.col("bx") - F.col("ax"))
        return F.col("ay") + F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * (F.col("by") - F.col("ay"))

    left, right = height(F.col("cx") * F.col("w") - margin), height((F.col("cx") + 1) * F.col("w") + margin)
    upright = F.col("ax") == F.col("bx")
    ends = [F.when(upright, F.col("ay")).otherwise(left), F.when(upright, F.col("by")).otherwise(right)]
    rows = F.sequence(F.floor((F.least(*ends) - margin) / F.col("w")), F.floor((F.greatest(*ends) + margin) / F.col("w")))
    return by_column.withColumn("cy", F.explode(rows)).drop("w")


def adjacent_tracts(tracts: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Edges between tracts of one area whose outlines touch or nearly touch.

    Tracts that share an edge are found by the edge itself. The others are compared segment by
    segment, where two segments come near the same grid cell, by column expressions alone.
    """
    segments = _segments(tracts)
    keys = ["cbsa_id", "ax", "ay", "bx", "by"]
    owners = segments.groupBy(*keys).agg(F.sort_array(F.collect_set("tract_id")).alias("t")).where(F.size("t") > 1)
    other = F.filter("t", lambda x: x > F.col("tract_id"))
    sharing = (
        owners.select("t", F.explode("t").alias("tract_id"))
        .select("tract_id", F.explode(other).alias("neighbor_id"))
        .distinct()
    )
    placed = _cells(segments, tolerance)
    second = placed.select("cbsa_id", "cx", "cy", *[F.col(c).alias(f"o{c}") for c in ("tract_id", "ax", "ay", "bx", "by")])
    near = placed.join(second, ["cbsa_id", "cx", "cy"]).where(
        (F.col("tract_id") < F.col("otract_id"))
        & (F.col("ax") - tolerance <= F.col("obx")) & (F.col("oax") - tolerance <= F.col("bx"))
        & (F.least("ay", "by") - tolerance <= F.greatest("oay", "oby"))
        & (F.least("oay", "oby") - tolerance <= F.greatest("ay", "by"))
    )
    touching = (
        near.withColumnRenamed("otract_id", "neighbor_id")
        .join(sharing, ["tract_id", "neighbor_id"], "left_anti")
        .where(segment_distance("", "o") < tolerance)
        .select("tract_id", "neighbor_id")
        .distinct()
    )
    pair = F.explode(
        F.array(
            F.struct(F.col("tract_id").alias("a"), F.col("neighbor_id").alias("b")),
            F.struct(F.col("neighbor_id").alias("a"), F.col("tract_id").alias("b")),
        )
    )
    found = touching.unionByName(sharing)
    return found.select(pair.alias("e")).select(F.col("e.a").alias("tract_id"), F.col("e.b").alias("neighbor_id"))


def nearest_tracts(tracts: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest tracts of the same area by centroid, ties by tract id. Exact.

    Grids of doubling cell width are laid over each area. A tract takes the finest level
    whose 3x3 block around it holds enough others; the k-th nearest is then closer than
    three cell widths, so the block two levels up, whose border is at least four such
    widths away, holds all of them.
    """
    levels = 24
    points = tracts.select("tract_id", "cbsa_id", F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"))
    area = points.groupBy("cbsa_id").agg(
        F.min("x").alias("_x0"),
        F.min("y").alias("_y0"),
        F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)).alias("_span"),
    )
    spread = points.join(area, "cbsa_id")
    # Of tracts at one point only the first k+1 ids can be among anyone's k nearest.
    same_point = Window.partitionBy("cbsa_id", "x", "y").orderBy("tract_id")
    targets = spread.withColumn("_copy", F.row_number().over(same_point)).where(F.col("_copy") <= k + 1).drop("_copy")

    def cell(axis: str, low: str, level):
        width = F.col("_span") / F.pow(F.lit(2.0), level)
        return F.floor((F.col(axis) - F.col(low)) / width)

    # Count occupied cells level by level; a level is a number, 0 being the coarsest.
    every_level = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    occupied = (
        targets.withColumn("level", every_level)
        .select("cbsa_id", "level", cell("x", "_x0", F.col("level")).alias("cx"), cell("y", "_y0", F.col("level")).alias("cy"))
        .groupBy("cbsa_id", "level", "cx", "cy")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    blocks = (
        occupied.withColumn("s", step)
        .select("cbsa_id", "level", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"), "n")
        .groupBy("cbsa_id", "level", "cx", "cy")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= k + 1)
        .drop("n")
    )
    deepest = (
        spread.withColumn("level", every_level)
        .withColumn("cx", cell("x", "_x0", F.col("level")))
        .withColumn("cy", cell("y", "_y0", F.col("level")))
        .join(blocks, ["cbsa_id", "level", "cx", "cy"], "left_semi")
        .groupBy("tract_id")
        .agg(F.max("level").alias("_enough"))
    )
    search = spread.join(deepest, "tract_id", "left").withColumn(
        "level", F.greatest(F.coalesce(F.col("_enough"), F.lit(0)) - 2, F.lit(-2))
    )
    # From two levels above the coarsest on, one block covers the whole area.
    around = (
        search.withColumn("_cx", cell("x", "_x0", F.col("level")))
        .withColumn("_cy", cell("y", "_y0", F.col("level")))
        .withColumn("s", step)
        .select(
            "tract_id", "cbsa_id", "x", "y", "level",
            (F.col("_cx") + F.col("s.i")).alias("cx"), (F.col("_cy") + F.col("s.j")).alias("cy"),
        )
    )
    used = search.select("cbsa_id", "level").distinct()
    located = (
        targets.join(used, "cbsa_id")
        .select(
            F.col("tract_id").alias("neighbor_id"), F.col("x").alias("nx"), F.col("y").alias("ny"), "cbsa_id", "level",
            cell("x", "_x0", F.col("level")).alias("cx"), cell("y", "_y0", F.col("level")).alias("cy"),
        )
    )
    order = Window.partitionBy("tract_id").orderBy("distance", "neighbor_id")
    return (
        around.join(located, ["cbsa_id", "level", "cx", "cy"])
        .where("tract_id <> neighbor_id")
        .withColumn("distance", F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny")))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("cbsa_id", "tract_id", "neighbor_id", "rank", "distance")
    )


def area_summary(tracts: DataFrame) -> DataFrame:
    """Tract count, most common state and totals per area."""
    return tracts.groupBy("cbsa_id").agg(
        F.mode("state", True).alias("state"),
        F.count(F.lit(1)).alias("tract_count"),
        F.sum("population").alias("total_population"),
        F.sum("area_sqmi").alias("total_area_sqmi"),
    )
