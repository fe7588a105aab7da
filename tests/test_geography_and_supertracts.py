import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.config import SupertractOptions
from hearthline.operators import geography, supertracts

COUNTS = "tract_id string, year int, half_pairs bigint"


def tract_table(spark, places):
    return spark.createDataFrame(places, "tract_id string, cbsa_id string, centroid_x double, centroid_y double")


def build(spark, counts, edges, area="C", **options):
    tracts = tract_table(spark, [(t, area, float(i), 0.0) for i, (t, _) in enumerate(counts)])
    table = spark.createDataFrame([(t, 2020, n) for t, n in counts], COUNTS)
    links = spark.createDataFrame(edges, "tract_id string, neighbor_id string")
    return supertracts.build_supertracts(table, tracts, links, SupertractOptions(**options))


def shape(built):
    return {(tuple(r.component_tract_ids), r.half_pairs_count, r.is_merged) for r in built.collect()}


def test_thin_neighbours_merge_and_large_tracts_stay_alone(spark):
    built = build(spark, [("T1", 30), ("T2", 24), ("T3", 50)], [("T1", "T2"), ("T2", "T3")])
    assert shape(built) == {(("T1", "T2"), 54, True), (("T3",), 50, False)}
    chain = build(
        spark, [("T1", 60), ("T2", 20), ("T3", 20), ("T4", 20)], [("T1", "T2"), ("T2", "T3"), ("T3", "T4")]
    )
    assert (("T1",), 60, False) in shape(chain) and (("T2", "T3"), 40, True) in shape(chain)


def test_absorbed_large_tract_is_listed_twice_and_hopeless_group_left_out(spark):
    built = build(spark, [("T1", 10), ("T2", 50), ("T9", 5)], [("T1", "T2")])
    assert shape(built) == {(("T1", "T2"), 60, True), (("T2",), 50, False)}
    bridge = {r.tract_id: r.supertract_id for r in supertracts.tract_bridge(built).collect()}
    assert bridge == {"T1": supertracts.group_id(["T1", "T2"]), "T2": supertracts.group_id(["T2", "T1"])}
    yearly = {r.tract_id: r.supertract_id for r in supertracts.yearly_mapping(built).collect()}
    assert yearly["T2"] == "super_T2"


def test_row_order_does_not_matter(spark):
    rng = np.random.default_rng(4)
    counts = [(f"T{i:02d}", int(rng.integers(5, 60))) for i in range(20)]
    edges = [(f"T{i:02d}", f"T{j:02d}") for i in range(20) for j in range(i) if rng.random() < 0.15]
    first = shape(build(spark, counts, edges))
    assert first == shape(build(spark, counts[::-1], [(b, a) for a, b in edges[::-1]]))
    merged = [t for parts, _, together in first if together for t in parts]
    assert len(merged) == len(set(merged))


def test_nearest_centroid_and_prior_year(spark):
    tracts = tract_table(spark, [("T1", "C", 0.0, 0.0), ("T2", "C", 5.0, 0.0), ("T3", "C", 1.0, 0.0)])
    counts = spark.createDataFrame(
        [("T1", 2020, 20), ("T2", 2020, 25), ("T3", 2020, 30), ("T1", 2019, 20), ("T2", 2019, 90), ("T3", 2019, 5)], COUNTS
    )
    options = SupertractOptions(strategy="nearest_centroid")
    built = supertracts.build_supertracts(counts, tracts, None, options).where("year = 2020")
    assert (("T1", "T3"), 50, True) in shape(built)
    both = SupertractOptions(strategy="nearest_centroid", require_prior_year=True)
    strict = supertracts.build_supertracts(counts, tracts, None, both).where("year = 2020")
    assert shape(strict) == {(("T1", "T2", "T3"), 75, True)}


def test_regions_join_areas_that_touch(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "tract_id string, neighbor_id string")
    got = {r.tract_id: r.region for r in supertracts.connected_regions(edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_nearest_tracts_equal_a_full_search(spark):
    rng = np.random.default_rng(6)
    places = [(f"A{i:03d}", "A", *map(float, rng.normal(size=2) * (0.01 if i % 3 else 10))) for i in range(120)]
    places += [(f"B{i:03d}", "B", 1.0, 1.0) for i in range(30)] + [("C1", "C", 0.0, 0.0), ("C2", "C", 9.0, 9.0)]
    got = {(r.tract_id, r["rank"]): r.neighbor_id for r in geography.nearest_tracts(tract_table(spark, places), 4).collect()}
    want = {}
    for tract, area, x, y in places:
        near = sorted((float(np.hypot(x - u, y - v)), t) for t, a, u, v in places if a == area and t != tract)
        want |= {(tract, i): t for i, (_, t) in enumerate(near[:4], 1)}
    assert got == want


def test_adjacency_equals_a_full_comparison_of_rectangles(spark):
    rng = np.random.default_rng(7)
    boxes = []
    for i in range(60):
        x, y = rng.integers(0, 10, 2) / 2
        w, h = (0.5 + rng.integers(0, 3, 2)) / (1 if i else 0.1)
        boxes.append((f"T{i:02d}", "AB"[i % 2], float(x), float(y), float(x + w), float(y + h)))
    rows = [(t, a, [[x, y], [u, y], [u, v], [x, v], [x, y]]) for t, a, x, y, u, v in boxes]
    tracts = spark.createDataFrame(rows, "tract_id string, cbsa_id string, geometry array<array<double>>")
    got = {(r.tract_id, r.neighbor_id) for r in geography.adjacent_tracts(tracts).collect()}
    want = set()
    for t, a, x, y, u, v in boxes:
        for s, b, p, q, m, n in boxes:
            if a == b and s != t:
                apart = np.hypot(max(0, p - u, x - m), max(0, q - v, y - n)) >= 0.001
                inside = (x < p and m < u and y < q and n < v) or (p < x and u < m and q < y and v < n)
                if not apart and not inside:
                    want.add((t, s))
    assert got == want


def outline_gap(p, q):
    """Least distance between the edges of two rings, 0 where they cross, edge by edge."""
    best = np.inf
    for a, b in zip(p, p[1:]):
        for c, d in zip(q, q[1:]):
            a, b, c, d = (np.array(x, float) for x in (a, b, c, d))

            def turn(o, u, v):
                return (u[0] - o[0]) * (v[1] - o[1]) - (u[1] - o[1]) * (v[0] - o[0])

            if turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0:
                return 0.0
            for x, s, e in ((c, a, b), (d, a, b), (a, c, d), (b, c, d)):
                t = np.clip((x - s) @ (e - s) / max((e - s) @ (e - s), 1e-300), 0, 1)
                best = min(best, np.linalg.norm(s + t * (e - s) - x))
    return best


def test_adjacency_of_slanted_outlines_with_islands(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(50):
        rings = []
        for _ in range(rng.integers(1, 4)):
            corners = rng.uniform(0, 12, 2) + rng.normal(size=(rng.integers(3, 6), 2)) * rng.choice([0.1, 0.6, 2.0])
            if rng.random() < 0.4 and rows:  # a corner, or a point within an edge, of an earlier outline
                old = np.array(rows[rng.integers(len(rows))][2][0])
                corners[0] = old[0] if rng.random() < 0.5 else (old[0] + old[1]) / 2
            rings.append([list(map(float, c)) for c in [*corners, corners[0]]])
        rows.append((f"T{i:02d}", "AB"[i % 2], rings))
    rows.append(("T98", "A", [[[1.0, 1.0]], []]))
    rows.append(("T99", "A", None))
    tracts = spark.createDataFrame(rows, "tract_id string, cbsa_id string, rings array<array<array<double>>>").withColumn("geometry", F.col("rings")[0])
    for tolerance in (0.001, 0.2):
        want = {
            (t, s) for t, a, p in rows for s, b, q in rows
            if a == b and s != t and any(outline_gap(x, y) < tolerance for x in p or () for y in q or ())
        }
        assert {(r.tract_id, r.neighbor_id) for r in geography.adjacent_tracts(tracts, tolerance).collect()} == want
        assert len(want) > 40


def test_shared_edges_are_found_in_either_direction(spark):
    left, right = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]], [[1.0, 1.0], [1.0, 0.0], [2.0, 0.5], [1.0, 1.0]]
    tracts = spark.createDataFrame([("a", "X", left), ("b", "X", right), ("c", "Y", right)], "tract_id string, cbsa_id string, geometry array<array<double>>")
    assert {(r.tract_id, r.neighbor_id) for r in geography.adjacent_tracts(tracts).collect()} == {("a", "b"), ("b", "a")}
    plan = geography.adjacent_tracts(tracts)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_area_summary_takes_the_common_state(spark):
    rows = [("T1", "C", "02", 5, 1.0), ("T2", "C", "01", 6, 2.0), ("T3", "C", "01", 7, 3.0)]
    table = spark.createDataFrame(rows, "tract_id string, cbsa_id string, state string, population bigint, area_sqmi double")
    row = geography.area_summary(table).first()
    assert (row.state, row.tract_count, row.total_population) == ("01", 3, 18)
    assert row.total_area_sqmi == pytest.approx(6.0)


def test_groups_with_the_same_first_members_are_told_apart(spark):
    rows = [(t, y, 12) for y, names in ((2000, "ABCD"), (2001, "ABCE")) for t in names]
    counts = spark.createDataFrame(rows, "tract_id string, year int, half_pairs long")
    tracts = spark.createDataFrame([(t, "X") for t in "ABCDE"], "tract_id string, cbsa_id string")
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D"), ("C", "E")], "tract_id string, neighbor_id string")
    merged = supertracts.build_supertracts(counts, tracts, edges)
    rows = {tuple(r.component_tract_ids): r for r in merged.collect()}
    assert set(rows) == {tuple("ABCD"), tuple("ABCE")}
    assert len({r.supertract_id for r in rows.values()}) == 2 and {r.label for r in rows.values()} == {"super_A_B_C"}
    bridge = {r.tract_id: r.supertract_id for r in supertracts.tract_bridge(merged).collect()}
    assert bridge["D"] == bridge["A"] != bridge["E"]


def test_regions_of_a_long_chain_settle(spark):
    names = [f"t{i:04}" for i in range(150)]
    edges = spark.createDataFrame(list(zip(names, names[1:])), "tract_id string, neighbor_id string")
    assert {r.region for r in supertracts.connected_regions(edges).collect()} == {"t0000"}
