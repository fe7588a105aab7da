"""Merge thin tracts with their neighbours until each group has enough half-pairs.

The merge is sequential inside one region and year, so that much runs in one task. Its
input there is one row per tract with its neighbour list, bounded by geography.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.config import SupertractOptions
from hearthline.session import cut_lineage, spread

FIELDS = (
    "year int, region string, supertract_id string, label string, component_tract_ids array<string>, "
    "half_pairs_count bigint, is_merged boolean"
)


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected edges as two rows each, without loops or repeats."""
    forward = edges.select("tract_id", "neighbor_id")
    backward = edges.select(F.col("neighbor_id").alias("tract_id"), F.col("tract_id").alias("neighbor_id"))
    return forward.unionByName(backward).where("tract_id <> neighbor_id").distinct()


def group_id(members: list[str]) -> str:
    """Name of a merged group by all its members, so that groups share a name only if they are the same."""
    return "super_" + hashlib.sha1("\x1f".join(sorted(members)).encode()).hexdigest()


def connected_regions(edges: DataFrame) -> DataFrame:
    """Smallest tract id reachable from each tract; for adjacency that crosses areas.

    Labels move along edges and jump to their own label's label until none changes.
    """
    edges = cut_lineage(both_ways(edges))
    labels = cut_lineage(edges.select("tract_id", F.col("tract_id").alias("region")).distinct())
    while True:
        seen = edges.join(labels.withColumnRenamed("tract_id", "neighbor_id"), "neighbor_id")
        lowest = seen.groupBy("tract_id").agg(F.min("region").alias("_seen"))
        nearer = labels.join(lowest, "tract_id").select("tract_id", F.least("region", "_seen").alias("region"))
        jump = nearer.select(F.col("tract_id").alias("region"), F.col("region").alias("_further"))
        moved = cut_lineage(
            nearer.join(jump, "region").select("tract_id", F.col("_further").alias("region"))
        )
        changed = moved.join(labels, ["tract_id", "region"], "left_anti")
        labels = moved
        if changed.isEmpty():
            return labels


class _Running:
    """Sums of a growing group, this year's and, where asked for, the year before's."""

    def __init__(self, counts: dict, earlier: dict, minimum: int, prior_too: bool) -> None:
        self.counts, self.earlier, self.minimum, self.prior_too = counts, earlier, minimum, prior_too
        self.now = self.before = 0

    def start(self) -> None:
        self.now = self.before = 0

    def add(self, tract: str) -> bool:
        """Whether the group has enough with this tract."""
        self.now += self.counts[tract]
        self.before += self.earlier[tract]
        return self.now >= self.minimum and (not self.prior_too or self.before >= self.minimum)


def _by_adjacency(counts: dict, short: set, neighbors: dict, sums: _Running) -> list[list[str]]:
    """Grow each thin tract through its frontier, thin and small neighbours first."""
    groups, taken = [], set()
    for seed in sorted(short, key=lambda t: (counts[t], t)):
        if seed in taken:
            continue
        members, frontier, newest = [], [], seed
        sums.start()
        while True:
            members.append(newest)
            taken.add(newest)
            if sums.add(newest):
                groups.append(members)
                break
            for other in neighbors.get(newest, ()):
                if other in counts and other not in taken:
                    heapq.heappush(frontier, (other not in short, counts[other], other))
            while frontier and frontier[0][2] in taken:
                heapq.heappop(frontier)
            if not frontier:
                break
            newest = heapq.heappop(frontier)[2]
    return groups


def _nearest_first(names: np.ndarray, away: np.ndarray):
    """Names by distance, then name; only as many are sorted as are asked for."""
    done, size = 0, 64
    while done < len(names):
        reach = np.partition(away, min(size, len(away)) - 1)[min(size, len(away)) - 1]
        near = np.flatnonzero(away <= reach)
        order = near[np.lexsort((names[near], away[near]))]
        yield from names[order[done:]]
        done, size = len(order), size * 8


def _by_centroid(counts: dict, short: set, points: pd.DataFrame, sums: _Running) -> list[list[str]]:
    """Grow each thin tract with the nearest tracts not yet taken."""
    groups, taken = [], set()
    names = points.index.to_numpy()
    x, y = points["x"].to_numpy(float), points["y"].to_numpy(float)
    for seed in sorted(short, key=lambda t: (counts[t], t)):
        if seed in taken:
            continue
        at = points.index.get_loc(seed)
        members = [seed]
        sums.start()
        enough = sums.add(seed)
        for other in _nearest_first(names, np.hypot(x - x[at], y - y[at])):
            if enough:
                break
            if other != seed and other not in taken:
                members.append(other)
                enough = sums.add(other)
        taken.update(members)
        if enough:
            groups.append(members)
    return groups


def build_supertracts(
    counts: DataFrame,
    tracts: DataFrame,
    edges: DataFrame | None = None,
    options: SupertractOptions = SupertractOptions(),
    regions: DataFrame | None = None,
) -> DataFrame:
    """Supertracts of every year in one job.

    counts: tract_id, year, half_pairs. Groups that cannot reach the minimum are left out.
    A tract that is large enough by itself also stays as its own supertract, even when a
    neighbour's group has absorbed it. regions (tract_id, region) replaces the area as the
    unit of work where adjacency crosses areas.
    """
    minimum, prior_too = options.min_half_pairs, options.require_prior_year
    nearest = options.strategy == "nearest_centroid"
    if regions is None:
        regions = tracts.select("tract_id", F.col("cbsa_id").alias("region"))
    rows = counts.join(regions, "tract_id", "left").withColumn("region", F.coalesce("region", "tract_id"))
    prior = counts.select("tract_id", (F.col("year") + 1).alias("year"), F.col("half_pairs").alias("prior"))
    rows = rows.join(prior, ["tract_id", "year"], "left") if prior_too else rows.withColumn("prior", F.lit(0))
    if nearest:
        rows = rows.join(tracts.select("tract_id", "centroid_x", "centroid_y"), "tract_id")
    else:
        near = both_ways(edges).groupBy("tract_id").agg(F.collect_set("neighbor_id").alias("neighbors"))
        rows = rows.join(near, "tract_id", "left")

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        counts = dict(zip(frame["tract_id"], frame["half_pairs"].astype(int)))
        earlier = dict(zip(frame["tract_id"], frame["prior"].fillna(0).astype(int)))

        sums = _Running(counts, earlier, minimum, prior_too)

        def alone(tract):
            sums.start()
            return sums.add(tract)

        short = {t for t in counts if not alone(t)}
        if nearest:
            points = frame.set_index("tract_id").rename(columns={"centroid_x": "x", "centroid_y": "y"})
            merged = _by_centroid(counts, short, points, sums)
        else:
            near = {t: n for t, n in zip(frame["tract_id"], frame["neighbors"]) if n is not None}
            merged = _by_adjacency(counts, short, near, sums)
        out = [
            [*key, group_id(m), "super_" + "_".join(sorted(m)[:3]), sorted(m), sum(counts[t] for t in m), True] for m in merged
        ]
        out += [[*key, f"super_{t}", f"super_{t}", [t], counts[t], False] for t in counts if t not in short]
        return pd.DataFrame(out, columns=[f.split()[0] for f in FIELDS.split(", ")])

    return spread(rows, ["year", "region"]).groupBy("year", "region").applyInPandas(merge, FIELDS)


def tract_bridge(supertracts: DataFrame) -> DataFrame:
    """The supertract a tract's pairs are estimated with: earliest year, merged before single."""
    return (
        supertracts.select(F.explode("component_tract_ids").alias("tract_id"), "year", "is_merged", "supertract_id")
        .groupBy("tract_id")
        .agg(F.min_by("supertract_id", F.struct("year", ~F.col("is_merged"), "supertract_id")).alias("supertract_id"))
    )


def yearly_mapping(supertracts: DataFrame) -> DataFrame:
    """Tract to supertract within each year; the single-tract entry wins."""
    return (
        supertracts.select("year", F.explode("component_tract_ids").alias("tract_id"), "is_merged", "supertract_id")
        .groupBy("year", "tract_id")
        .agg(F.max_by("supertract_id", F.struct(~F.col("is_merged"), "supertract_id")).alias("supertract_id"))
    )


def check_supertracts(supertracts: DataFrame, counts: DataFrame, minimum: int = 40) -> DataFrame:
    """Expected against actual half-pairs of each supertract."""
    parts = supertracts.select(
        "year", "supertract_id", "half_pairs_count", F.explode("component_tract_ids").alias("tract_id")
    )
    return (
        parts.join(counts, ["tract_id", "year"], "left")
        .groupBy("year", "supertract_id")
        .agg(
            F.count(F.lit(1)).alias("component_tracts"),
            F.first("half_pairs_count").alias("expected_half_pairs"),
            F.coalesce(F.sum("half_pairs"), F.lit(0)).alias("actual_half_pairs"),
            F.count_if(F.col("half_pairs").isNull()).alias("unknown_tracts"),
        )
        .withColumns(
            {
                "meets_threshold": F.col("actual_half_pairs") >= minimum,
                "discrepancy": F.abs(F.col("actual_half_pairs") - F.col("expected_half_pairs")),
            }
        )
    )


def supertract_shape(supertracts: DataFrame) -> DataFrame:
    """Number of components and whether there is only one."""
    return supertracts.withColumns(
        {"tract_count": F.size("component_tract_ids"), "is_single_tract": F.size("component_tract_ids") == 1}
    )
