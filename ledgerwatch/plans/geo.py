"""Geospatial queries."""

from pyspark.sql import functions as F

from ledgerwatch.functions.columns import geohash, haversine_km
from ledgerwatch.operators import geo
from ledgerwatch.plans.aggregates import GEOHASH_SQL
from ledgerwatch.plans.joins import HAV, clusters, zones
from ledgerwatch.plans.registry import cte, query

BY_USER = "PARTITION BY user_id ORDER BY ts, transaction_id"
YEAR = 365 * 86400
GRADE = """CASE WHEN f >= 4 THEN 'critical' WHEN f >= 3 THEN 'high' WHEN f >= 2 THEN 'medium' ELSE 'low' END AS risk_level,
  CASE WHEN f >= 4 THEN 0.9e0 WHEN f >= 3 THEN 0.8e0 WHEN f >= 2 THEN 0.6e0 ELSE 0.4e0 END AS confidence"""
GRADED = """COUNT(*) AS transaction_count, AVG(fraud_score) AS avg_risk, COUNT(DISTINCT user_id) AS unique_users, SUM(amount) AS total_amount,
  AVG(latitude) AS center_lat, AVG(longitude) AS center_lon, CASE WHEN ROUND(AVG(fraud_score), 9) > 0.7e0 THEN 2 WHEN ROUND(AVG(fraud_score), 9) > 0.5e0 THEN 1 ELSE 0 END
  + CASE WHEN COUNT(DISTINCT user_id) > COUNT(*) * 0.7e0 THEN 2 ELSE 0 END + CASE WHEN SUM(amount) > 50000 THEN 1 ELSE 0 END AS f"""


def spots(t):
    return t.tx_place.select("transaction_id", "user_id", "ts", "amount", "fraud_score", "latitude", "longitude")


@query("GEO-1", uses="tx clusters", rounded="distance_km", places=4, sql=f"""
SELECT transaction_id, {HAV.format('latitude', 'longitude', '40.7128e0', '(-74.006e0)')} AS distance_km FROM tx
""")
def geo_1(t):
    return spots(t).select("transaction_id", haversine_km("latitude", "longitude", F.lit(40.7128), F.lit(-74.006)).alias("distance_km"))


@query("GEO-2", uses="tx", sql=f"""
WITH c AS (SELECT transaction_id, CAST(FLOOR((longitude + 180) / 360 * 262144) AS BIGINT) AS x, CAST(FLOOR((latitude + 90) / 180 * 131072) AS BIGINT) AS y FROM tx),
b AS (SELECT transaction_id, p // 5 AS k, CASE WHEN p % 2 = 0 THEN (x >> (17 - p // 2)) & 1 ELSE (y >> (16 - p // 2)) & 1 END << (4 - p % 5) AS bit FROM c, range(35) r(p)),
l AS (SELECT transaction_id, k, SUM(bit) AS v FROM b GROUP BY 1, 2)
SELECT transaction_id, {GEOHASH_SQL} AS cell FROM l GROUP BY 1
""")
def geo_2(t):
    return spots(t).select("transaction_id", geohash("latitude", "longitude", 7).alias("cell"))


@query("GEO-3", uses="tx", rounded="distance_km", places=4, sql=f"""
SELECT * FROM (SELECT transaction_id, {HAV.format('latitude', 'longitude', '(-22.5e0)', '12.5e0')} AS distance_km FROM tx) WHERE distance_km <= 3500
""")
def geo_3(t):
    return geo.within_distance(spots(t), -22.5, 12.5, 3500.0).select("transaction_id", "distance_km")


STEP = HAV.format("plat", "plon", "latitude", "longitude")
cte("steps", f"""
SELECT *, {STEP} AS step_km, (epoch_us(ts) - epoch_us(pts)) / 1e6 AS gap FROM (SELECT *, LAG(latitude) OVER w AS plat, LAG(longitude) OVER w AS plon, LAG(ts) OVER w AS pts,
  ROW_NUMBER() OVER w AS rn FROM tx WINDOW w AS ({BY_USER}))
""")
cte("vel", """
SELECT transaction_id, CASE WHEN gap IS NULL THEN 0e0 WHEN gap <= 0 THEN 1e0 WHEN step_km / (gap / 3600) > 800 THEN 1e0 WHEN step_km / (gap / 3600) > 300 THEN 0.8e0
  WHEN step_km / (gap / 3600) > 100 THEN 0.3e0 ELSE 0e0 END AS velocity_risk FROM steps
""")
cte("freq", f"""
SELECT transaction_id, n AS nearby_visits, CASE WHEN n = 1 THEN 0.6e0 WHEN n <= 3 THEN 0.3e0 ELSE 0e0 END AS frequency_risk FROM (
 SELECT a.transaction_id, COUNT(*) AS n FROM tx a JOIN tx b ON a.user_id = b.user_id AND b.ts <= a.ts AND {HAV.format('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= 5 GROUP BY 1)
""")
cte("outl", f"""
SELECT transaction_id, CASE WHEN rn < 5 THEN 0.2e0 WHEN sd > 0 THEN LEAST(1e0, abs({HAV.format('clat', 'clon', 'latitude', 'longitude')} - m) / sd / 3) ELSE 0e0 END AS outlier_risk FROM (
 SELECT a.transaction_id, ANY_VALUE(a.rn) AS rn, ANY_VALUE(a.latitude) AS latitude, ANY_VALUE(a.longitude) AS longitude, AVG(d) AS m, STDDEV_POP(d) AS sd, ANY_VALUE(clat) AS clat, ANY_VALUE(clon) AS clon FROM (
  SELECT a.*, CASE WHEN b.rn < a.rn THEN {HAV.format('b.latitude', 'b.longitude', 'a.latitude', 'a.longitude')} END AS d
  FROM (SELECT *, AVG(latitude) OVER ({BY_USER} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS clat, AVG(longitude) OVER ({BY_USER} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS clon FROM steps) a
  JOIN steps b ON a.user_id = b.user_id AND b.rn <= a.rn AND b.rn > a.rn - 20) a GROUP BY 1)
""")
cte("clus", f"""
SELECT transaction_id, GREATEST(0e0, MAX(CASE cluster_level WHEN 'CRITICAL' THEN 0.9e0 WHEN 'HIGH' THEN 0.7e0 ELSE 0.4e0 END * (1 - d / radius_km) * confidence)) AS cluster_risk FROM (
 SELECT transaction_id, clusters.*, {HAV.format('latitude', 'longitude', 'cluster_lat', 'cluster_lon')} AS d FROM tx, clusters WHERE cluster_type = 'hotspot') WHERE d <= radius_km GROUP BY 1
""")
cte("zon", """
SELECT transaction_id, MAX(CASE risk_level WHEN 'CRITICAL' THEN 0.9e0 WHEN 'HIGH' THEN 0.7e0 WHEN 'MEDIUM' THEN 0.4e0 ELSE 0.2e0 END) AS zone_risk FROM tx
JOIN zones ON latitude > south - 0.25e0 AND latitude < south + 0.355e0 AND longitude > west + 0.005e0 AND longitude < west + 0.605e0 GROUP BY 1
""")


@query("GEO-4", uses="tx steps vel freq outl clusters clus zones zon", rounded="geo_risk", sql="""
SELECT transaction_id, LEAST(1e0, velocity_risk * 0.25 + CASE WHEN v1.n = 1 THEN 0.6e0 WHEN v1.n <= 3 THEN 0.3e0 ELSE 0e0 END * 0.2 + outlier_risk * 0.2 + COALESCE(cluster_risk, 0) * 0.2 + COALESCE(zone_risk, 0) * 0.15) AS geo_risk
FROM vel JOIN (SELECT a.transaction_id, COUNT(*) AS n FROM tx a JOIN tx b ON a.user_id = b.user_id AND b.ts <= a.ts AND HAVERSINE <= 1 GROUP BY 1) v1 USING (transaction_id)
JOIN outl USING (transaction_id) LEFT JOIN clus USING (transaction_id) LEFT JOIN zon USING (transaction_id)
""".replace("HAVERSINE", HAV.format("a.latitude", "a.longitude", "b.latitude", "b.longitude")))
def geo_4(t):
    return geo.location_risk(spots(t), zones(t), clusters(t)).select("transaction_id", "geo_risk")


@query("GEO-5a", uses="tx steps vel", rounded="velocity_risk", sql="SELECT * FROM vel")
def geo_5a(t):
    return geo.velocity_risk(spots(t)).select("transaction_id", "velocity_risk")


@query("GEO-5b", uses="tx freq", rounded="frequency_risk", sql="SELECT * FROM freq")
def geo_5b(t):
    return geo.location_frequency(spots(t), 5.0).select("transaction_id", "nearby_visits", "frequency_risk")


@query("GEO-5c", uses="tx steps outl", rounded="outlier_risk", sql="SELECT * FROM outl")
def geo_5c(t):
    return geo.outlier_risk(spots(t)).select("transaction_id", "outlier_risk")


@query("GEO-5d", uses="tx clusters clus", rounded="cluster_risk", sql="SELECT transaction_id, COALESCE(cluster_risk, 0) AS cluster_risk FROM tx LEFT JOIN clus USING (transaction_id)")
def geo_5d(t):
    return geo.cluster_risk(spots(t), clusters(t)).select("transaction_id", "cluster_risk")


@query("GEO-5e", uses="tx zones zon", rounded="zone_risk", sql="SELECT transaction_id, COALESCE(zone_risk, 0) AS zone_risk FROM tx LEFT JOIN zon USING (transaction_id)")
def geo_5e(t):
    return geo.zone_risk(spots(t), zones(t)).select("transaction_id", "zone_risk")


G10 = "avg_risk total_amount center_lat center_lon confidence"


@query("GEO-6", uses="tx lim", rounded=G10, places=4, sql=f"""
SELECT * EXCLUDE (f), {GRADE} FROM (SELECT CAST(trunc(latitude / (20 / 111e0)) AS BIGINT) AS grid_lat, CAST(trunc(longitude / (20e0 / (111e0 * cos(radians(latitude))))) AS BIGINT) AS grid_lon, {GRADED}
 FROM tx, lim WHERE ts > as_of - INTERVAL 365 DAY GROUP BY 1, 2 HAVING COUNT(*) >= 10)
""")
def geo_6(t):
    return geo.grid_clusters(spots(t), 20.0, 10, YEAR)


@query("GEO-7")
def geo_7(t):
    """Density clusters of a year (iterative: checked against brute force in the tests)."""
    return geo.dbscan_clusters(spots(t), 4.0, 5, YEAR)


@query("GEO-8")
def geo_8(t):
    """Risk hotspots of the whole history (iterative: checked against brute force in the tests)."""
    return geo.hotspots(spots(t), 0.7, 3.0, 5, None)


@query("GEO-9")
def geo_9(t):
    """Space-time clusters (iterative: checked against brute force in the tests)."""
    return geo.spacetime_clusters(spots(t), 0.1, 5, YEAR)


@query("GEO-10", uses="tx", rounded=G10, places=4, sql=f"""
SELECT * EXCLUDE (f), {GRADE} FROM (SELECT CAST(FLOOR(latitude) AS BIGINT) AS y, CAST(FLOOR(longitude) AS BIGINT) AS x, CAST(month(ts) AS INTEGER) AS m, {GRADED} FROM tx GROUP BY 1, 2, 3)
""")
def geo_10(t):
    celled = spots(t).withColumns({"y": F.floor("latitude"), "x": F.floor("longitude"), "m": F.month("ts")})
    return geo.grade(celled, ["y", "x", "m"])


@query("GEO-11", uses="tx", rounded="duration_hours transactions_per_hour", sql="""
WITH d AS (SELECT CAST(FLOOR(latitude * 10) AS BIGINT) AS y, CAST(FLOOR(longitude * 10) AS BIGINT) AS x, ts, hour(ts) AS h, isodow(ts) - 1 AS w FROM tx),
hh AS (SELECT y, x, h, COUNT(*) AS n FROM d GROUP BY 1, 2, 3), ww AS (SELECT y, x, w, COUNT(*) AS n FROM d GROUP BY 1, 2, 3),
hd AS (SELECT y, x, string_agg(h || ':' || n, '|' ORDER BY h || ':' || n) AS hour_distribution, CAST(arg_max(h, n * 100 - h) AS INTEGER) AS peak_hour FROM hh GROUP BY 1, 2),
wd AS (SELECT y, x, string_agg(w || ':' || n, '|' ORDER BY w || ':' || n) AS weekday_distribution FROM ww GROUP BY 1, 2)
SELECT *, events / GREATEST(1, duration_hours) AS transactions_per_hour FROM (SELECT y, x, MIN(ts) AS start_time, MAX(ts) AS end_time, (epoch_us(MAX(ts)) - epoch_us(MIN(ts))) / 3.6e9 AS duration_hours, COUNT(*) AS events FROM d GROUP BY 1, 2)
JOIN hd USING (y, x) JOIN wd USING (y, x)
""")
def geo_11(t):
    celled = t.tx_place.select(F.floor(F.col("latitude") * 10).alias("y"), F.floor(F.col("longitude") * 10).alias("x"), "ts")
    return geo.temporal_pattern(celled, ["y", "x"])


cte("homes", f"""
SELECT user_id, hy AS home_lat, hx AS home_lon FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY n DESC, ry, rx) AS r FROM (
 SELECT user_id, ROUND(latitude, 3) AS ry, ROUND(longitude, 3) AS rx, COUNT(*) AS n, arg_min(latitude, (ts, transaction_id)) AS hy, arg_min(longitude, (ts, transaction_id)) AS hx FROM tx GROUP BY 1, 2, 3)) WHERE r = 1
""")


@query("GEO-12", uses="tx steps homes", places=4, rounded="home_lat home_lon travel_radius_km max_km_per_hour avg_km_per_hour anomaly_threshold", sql=f"""
SELECT user_id, home_lat, home_lon, travel_radius_km, COALESCE(m, 100) AS max_km_per_hour, COALESCE(a, 25) AS avg_km_per_hour, GREATEST(500, COALESCE(m, 100) * 2) AS anomaly_threshold
FROM homes JOIN (SELECT user_id, quantile_cont({HAV.format('home_lat', 'home_lon', 'latitude', 'longitude')}, 0.95) AS travel_radius_km FROM tx JOIN homes USING (user_id) GROUP BY 1) USING (user_id)
JOIN (SELECT user_id, MAX(s) AS m, AVG(s) AS a FROM (SELECT user_id, CASE WHEN gap > 0 THEN step_km / (gap / 3600) END AS s FROM steps) GROUP BY 1) USING (user_id)
""")
def geo_12(t):
    return geo.travel_patterns(spots(t))


@query("GEO-13", uses="tx", rounded="latitude longitude", sql=f"""
WITH s AS (SELECT user_id, CAST(trunc(latitude / (40 / 111e0)) AS BIGINT) AS gy, CAST(trunc(longitude / (40e0 / (111e0 * cos(radians(latitude))))) AS BIGINT) AS gx, latitude, longitude FROM tx),
c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY visits DESC, gy, gx) AS place FROM (SELECT user_id, gy, gx, COUNT(*) AS visits, AVG(latitude) AS cy, AVG(longitude) AS cx FROM s GROUP BY 1, 2, 3 HAVING COUNT(*) >= 2))
SELECT user_id, CAST(place AS INTEGER) AS place, visits, latitude, longitude FROM (SELECT s.*, place, visits,
  ROW_NUMBER() OVER (PARTITION BY s.user_id, s.gy, s.gx ORDER BY ROUND({HAV.format('cy', 'cx', 'latitude', 'longitude')}, 6), latitude, longitude) AS r
  FROM s JOIN c ON s.user_id = c.user_id AND s.gy = c.gy AND s.gx = c.gx WHERE place <= 5) WHERE r = 1
""")
def geo_13(t):
    return geo.frequent_locations(spots(t), 40.0)


@query("GEO-14", uses="tx steps", rounded="step_km gap_seconds speed_kmh anomaly_threshold", places=4, sql="""
WITH p AS (SELECT user_id, COALESCE(MAX(CASE WHEN gap > 0 THEN step_km / (gap / 3600) END), 0.1e0) * 2 AS anomaly_threshold FROM steps WHERE ts < TIMESTAMP '1997-01-01' GROUP BY 1)
SELECT transaction_id, user_id, step_km, gap AS gap_seconds, CASE WHEN gap > 0 THEN step_km / (gap / 3600) END AS speed_kmh, anomaly_threshold
FROM steps JOIN p USING (user_id) WHERE (gap <= 0 AND step_km > 0) OR (gap > 0 AND step_km / (gap / 3600) > anomaly_threshold)
""")
def geo_14(t):
    early = spots(t).filter(F.col("ts") < F.lit("1997-01-01").cast("timestamp"))
    patterns = geo.travel_steps(early).groupBy("user_id").agg(
        (F.coalesce(F.max("speed_kmh"), F.lit(0.1)) * 2).alias("anomaly_threshold")
    )
    return geo.suspicious_movements(spots(t), patterns).drop("prev_latitude", "prev_longitude", "prev_ts")


@query("GEO-15", uses="tx steps", rounded="speed_kmh profile_max profile_avg", places=4, sql=f"""
WITH s AS (SELECT *, CASE WHEN gap > 0 THEN step_km / (gap / 3600) END AS speed FROM steps),
r AS (SELECT transaction_id, user_id, rn, speed, MAX(speed) OVER ({BY_USER} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mx, AVG(speed) OVER ({BY_USER} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS av, ts FROM s),
h AS (SELECT transaction_id, user_id, speed, list(mx) FILTER (WHERE mx IS NOT NULL) OVER ({BY_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ms,
  list(av) FILTER (WHERE av IS NOT NULL) OVER ({BY_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS av FROM r)
SELECT transaction_id, user_id, speed AS speed_kmh, COALESCE(list_sum(list_transform(range(len(ms)), lambda i: 0.1e0 * pow(0.9e0, i) * ms[len(ms) - i])), 0) + pow(0.9e0, COALESCE(len(ms), 0)) * 100 AS profile_max,
  COALESCE(list_sum(list_transform(range(len(av)), lambda i: 0.1e0 * pow(0.9e0, i) * av[len(av) - i])), 0) + pow(0.9e0, COALESCE(len(av), 0)) * 25 AS profile_avg FROM h
""")
def geo_15(t):
    return geo.velocity_profile(spots(t))


@query("GEO-16", uses="tx zones zon clusters", rounded="location_risk", sql=f"""
SELECT transaction_id, COALESCE(zone_risk, r, 0.1e0) AS location_risk FROM tx LEFT JOIN zon USING (transaction_id) LEFT JOIN (
 SELECT transaction_id, arg_min(CASE cluster_level WHEN 'CRITICAL' THEN 0.8e0 WHEN 'HIGH' THEN 0.6e0 ELSE 0.4e0 END * GREATEST(0e0, 1 - d / (radius_km * 2)) * confidence, d) AS r FROM (
  SELECT transaction_id, clusters.*, {HAV.format('latitude', 'longitude', 'cluster_lat', 'cluster_lon')} AS d FROM tx, clusters WHERE cluster_type = 'hotspot') WHERE d <= radius_km * 2 GROUP BY 1) USING (transaction_id)
""")
def geo_16(t):
    return geo.location_scores(spots(t), zones(t), clusters(t))


@query("GEO-17", uses="tx clusters", rounded="avg_risk_score total_amount time_span_hours transactions_per_hour", places=4, sql=f"""
SELECT cluster_id AS probe_id, COUNT(transaction_id) AS transaction_count, COALESCE(AVG(fraud_score), 0) AS avg_risk_score, COUNT(DISTINCT user_id) AS unique_users, COUNT(DISTINCT merchant_id) AS unique_merchants,
  COALESCE(SUM(amount), 0) AS total_amount, COALESCE((epoch_us(MAX(ts)) - epoch_us(MIN(ts))) / 3.6e9, 0) AS time_span_hours,
  COALESCE(COUNT(transaction_id) / GREATEST(1, (epoch_us(MAX(ts)) - epoch_us(MIN(ts))) / 3.6e9), 0) AS transactions_per_hour
FROM clusters LEFT JOIN tx ON {HAV.format('cluster_lat', 'cluster_lon', 'latitude', 'longitude')} <= 25 GROUP BY 1
""")
def geo_17(t):
    probes = clusters(t).select(F.col("cluster_id").alias("probe_id"), F.col("cluster_lat").alias("latitude"), F.col("cluster_lon").alias("longitude"))
    facts = t.tx.select("ts", "fraud_score", "user_id", "merchant_id", "amount", "latitude", "longitude")
    return geo.area_statistics(facts, probes, 25.0)


@query("GEO-18", uses="tx clusters zones", rounded="distance_km", places=4, sql=f"""
SELECT 'transactions' AS layer, transaction_id AS id, distance_km FROM (SELECT transaction_id, {HAV.format('latitude', 'longitude', '(-20e0)', '0e0')} AS distance_km FROM tx) WHERE distance_km <= 3000
UNION ALL SELECT * FROM (SELECT 'clusters', CAST(cluster_id AS VARCHAR), {HAV.format('cluster_lat', 'cluster_lon', '(-20e0)', '0e0')} AS d FROM clusters) WHERE d <= 3000
UNION ALL SELECT * FROM (SELECT 'zones', CAST(zone_id AS VARCHAR), {HAV.format('(south + 0.0525e0)', '(west + 0.305e0)', '(-20e0)', '0e0')} AS d FROM zones) WHERE d <= 3000
""")
def geo_18(t):
    layers = geo.map_extract(spots(t), clusters(t), zones(t), -20.0, 0.0, 3000.0)
    ids = {"transactions": "transaction_id", "clusters": "cluster_id", "zones": "zone_id"}
    parts = [d.select(F.lit(n).alias("layer"), F.col(ids[n]).cast("string").alias("id"), "distance_km") for n, d in layers.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


