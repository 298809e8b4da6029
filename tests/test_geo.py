"""Distances, cells, polygons and density clusters against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerwatch.functions.columns import geohash, haversine_km, inside_polygon
from ledgerwatch.operators import clustering as cl
from ledgerwatch.operators import geo
from ledgerwatch.operators import joins as jn

from .conftest import rows


def km(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (*a, *b))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def labels(points, near, min_points):
    """Plain density clustering: the set of core groups and the border points' possible groups."""
    n = len(points)
    nb = [[j for j in range(n) if near(points[i], points[j])] for i in range(n)]
    core = [len(x) >= min_points for x in nb]
    group, current = [-1] * n, 0
    for i in range(n):
        if core[i] and group[i] < 0:
            todo, group[i] = [i], current
            while todo:
                for j in nb[todo.pop()]:
                    if core[j] and group[j] < 0:
                        group[j] = current
                        todo.append(j)
            current += 1
    border = [{group[j] for j in nb[i] if core[j]} if not core[i] else {group[i]} for i in range(n)]
    return core, group, border


def test_haversine_known_distance(spark):
    row = spark.range(1).select(haversine_km(F.lit(40.7128), F.lit(-74.006), F.lit(51.5074), F.lit(-0.1278)).alias("d")).first()
    assert row.d == pytest.approx(km((40.7128, -74.006), (51.5074, -0.1278)))
    assert 5560 < row.d < 5580


def test_geohash_known_values(spark):
    df = spark.createDataFrame([(57.64911, 10.40744), (-25.382708, -49.265506), (90.0, 180.0)], "a double, o double")
    assert [r[0] for r in df.select(geohash("a", "o", 7)).collect()] == ["u4pruyd", "6gkzwgj", "zzzzzzz"]


def test_polygon_edges_and_concave_ring(spark):
    ring = F.array(*[F.struct(F.lit(float(y)).alias("lat"), F.lit(float(x)).alias("lon")) for y, x in [(0, 0), (0, 4), (4, 4), (1, 2), (4, 0)]])
    df = spark.createDataFrame([(0.5, 2.0, True), (3.0, 2.0, False), (3.0, 0.5, True), (-1.0, 2.0, False)], "y double, x double, e boolean")
    assert all(r[0] == r[1] for r in df.select(inside_polygon(F.col("y"), F.col("x"), ring), "e").collect())


@pytest.mark.parametrize("radius", [5.0, 300.0, 4000.0, 15000.0])
def test_radius_join_at_poles_and_antimeridian(spark, radius):
    rng = np.random.RandomState(3)
    spots = [(89.99, 10.0), (89.98, -170.0), (-89.9, 0.0), (-90.0, 50.0), (0.0, 179.99), (0.01, -179.98), (60.0, 179.9), (60.0, -179.9), (0.0, 0.0)]
    spots += [(float(a), float(o)) for a, o in zip(rng.uniform(-90, 90, 60), rng.uniform(-180, 180, 60))]
    spots += [(a + 0.01, max(-180.0, min(180.0, o + 0.02))) for a, o in spots[9:40] if a < 89]
    df = spark.createDataFrame([(i, a, o) for i, (a, o) in enumerate(spots)], "id int, latitude double, longitude double")
    got = {(r.id, r.near_id) for r in jn.radius_join(df, df, radius).select("id", "near_id").collect()}
    assert got == {(i, j) for i in range(len(spots)) for j in range(len(spots)) if km(spots[i], spots[j]) <= radius}


def test_radius_boundary_one_kilometre(spark):
    step = math.degrees(1.0 / 6371.0)
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, step * 0.999, 0.0), (2, step * 1.001, 0.0)], "id int, latitude double, longitude double")
    near = [r.near_id for r in jn.radius_join(df.filter("id = 0"), df, 1.0).collect()]
    assert sorted(near) == [0, 1]


def test_cluster_join_keeps_small_and_huge_clusters(spark):
    points = spark.createDataFrame([("a", 10.0, 10.0), ("b", -60.0, 100.0)], "transaction_id string, latitude double, longitude double")
    rows = [(1, 10.0, 10.0, 0.0), (2, 0.0, 0.0, 20000.0), (3, 10.0, 10.01, 2.0), (4, 11.0, 10.0, 50.0)]
    clusters = spark.createDataFrame(rows, "cluster_id int, cluster_lat double, cluster_lon double, radius_km double")
    got = {(r.transaction_id, r.cluster_id) for r in jn.cluster_join(points, clusters).collect()}
    places = {"a": (10.0, 10.0), "b": (-60.0, 100.0)}
    assert got == {(t, c) for t, p in places.items() for c, y, x, r in rows if km(p, (y, x)) <= r}


@pytest.mark.parametrize("seed,eps,need", [(1, 3.0, 4), (2, 6.0, 5), (3, 1.5, 3)])
def test_dbscan_is_brute_force(spark, seed, eps, need):
    rng = np.random.RandomState(seed)
    spots = [(float(a), float(o)) for a, o in rng.normal(0, 0.12, (150, 2))] + [(0.0, 0.5)] * 6 + [(0.3, 0.5)] * 2
    df = spark.createDataFrame([(i, a, o, 0.9, 1, 1.0) for i, (a, o) in enumerate(spots)], "id int, latitude double, longitude double, fraud_score double, user_id int, amount double")
    got = {r.id: (r.cluster_id, r.is_core) for r in geo.dbscan_labels(df, eps, need, None).collect()}
    core, group, border = labels(spots, lambda p, q: km(p, q) <= eps, need)
    names = {}
    for i in range(len(spots)):
        assert got[i][1] == core[i]
        if core[i]:
            assert names.setdefault(group[i], got[i][0]) == got[i][0]
    assert len(set(names.values())) == len(names)
    for i in range(len(spots)):
        if not core[i]:
            allowed = {names[g] for g in border[i]}
            assert got[i][0] == (min(allowed) if allowed else None)


def test_dbscan_links_cells_through_the_exact_step(spark):
    """Facing extremes are too far apart, yet one pair links the cells: only the exact test finds it."""
    rng = np.random.RandomState(5)
    frame = pd.DataFrame(rng.uniform(0, 2.2, (220, 3)), columns=list(cl.AXES)).assign(id=range(220))
    points = frame[list(cl.AXES)].to_numpy()
    got = {r.id: r.cluster_id for r in cl.dbscan(spark.createDataFrame(frame), 0.27, 3).collect()}
    core, group, _ = labels([tuple(p) for p in points], lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q)) <= 0.27**2, 3)
    pairs = {(group[i], got[i]) for i in range(220) if core[i]}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_spacetime_clusters_are_brute_force(spark, tables):
    rows = tables.tx_place.orderBy("transaction_id").limit(300).select("transaction_id", "user_id", "ts", "amount", "fraud_score", "latitude", "longitude")
    got = {r.transaction_id: r.cluster_id for r in geo.spacetime_labels(rows, 0.4, 3, None).collect()}
    frame = rows.toPandas()
    x = np.column_stack([
        frame.latitude * 111.0, frame.longitude * 111.0 * np.cos(np.radians(frame.latitude)),
        (frame.ts - pd.Timestamp("1970-01-01")).dt.total_seconds() / 3600,
    ])
    x = (x - x.mean(0)) / x.std(0)
    core, group, _ = labels([tuple(p) for p in x], lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q)) <= 0.16, 3)
    pairs = {(group[i], got[t]) for i, t in enumerate(frame.transaction_id) if core[i]}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_hotspot_leaders_follow_the_greedy_order(spark):
    rng = np.random.RandomState(11)
    spots = [(round(float(a), 3), round(float(o), 3)) for a, o in rng.normal(0, 0.03, (120, 2))]
    df = spark.createDataFrame([(a, o, 0.9, 1.0) for a, o in spots], "latitude double, longitude double, fraud_score double, amount double")
    got = {(r.latitude, r.longitude): r.transaction_count for r in geo.hotspots(df, 0.7, 1.5, 5, None).collect()}
    places = sorted(set(spots))
    count = {p: sum(km(p, q) <= 1.5 for q in spots) for p in places}
    leaders, covered = {}, set()
    for p in sorted((p for p in places if count[p] >= 5), key=lambda p: (-count[p], p)):
        if p not in covered:
            leaders[p] = count[p]
            covered |= {q for q in places if km(p, q) <= 1.5}
    assert got == leaders


def test_visits_are_alike_by_pairs_and_by_places(spark, monkeypatch):
    """Equal rows, equal times, users, places and times that are missing; a busy user keeps to the grid of places."""
    rng = np.random.RandomState(8)
    log = [(f"t{i}", int(i % 3), int(rng.randint(0, 40)), 50.0 + rng.randint(0, 9) / 100, 179.9 + rng.randint(0, 3) / 10 - 360 * int(i % 5 == 0)) for i in range(120)]
    log += log[:6] + [("n1", None, 3, 50.05, 179.9), ("n2", 1, None, 50.05, 179.9), ("n3", 1, None, 50.05, 179.9), ("n4", 1, 5, None, 179.9), ("n5", 2, 5, 50.05, None)]
    df = spark.createDataFrame(log, "transaction_id string, user_id long, s long, latitude double, longitude double").withColumn("ts", F.timestamp_seconds("s"))
    pairs, places = geo._visits_by_pairs(df, 9.0), geo._visits_by_places(df, 9.0, 10**6)
    assert rows(pairs) == rows(places) and pairs.count() == 128
    plain = {t: sum(u2 == u and (s2 is None or s is not None and s2 <= s) and None not in (y2, x2) and km((y, x), (y2, x2)) <= 9.0 for _, u2, s2, y2, x2 in log)
             for t, u, s, y, x in log if None not in (u, y, x)}
    assert dict(pairs.collect()) == plain
    monkeypatch.setattr(geo, "BUSY_ROWS", 45)
    assert {r.transaction_id: r.nearby_visits for r in geo.location_frequency(df, 9.0).collect()} == plain
