"""Geospatial risk, clusters and travel patterns.  Distances are great-circle kilometres (R = 6371 km)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions import timeline as tl
from ledgerwatch.functions.columns import haversine_km, micros
from ledgerwatch.operators import clustering as cl
from ledgerwatch.operators import joins as jn
from ledgerwatch.operators import windows as wn
from ledgerwatch.operators.common import since
from ledgerwatch.session import cut_lineage

LEVEL_RISK = {"CRITICAL": 0.9, "HIGH": 0.7, "MEDIUM": 0.4}
LOCATION_RISK = {"CRITICAL": 0.8, "HIGH": 0.6, "MEDIUM": 0.4}


def by_level(level: Column, table: dict[str, float], other: float = 0.2) -> Column:
    out = F.lit(other)
    for name, value in table.items():
        out = F.when(level == name, F.lit(value)).otherwise(out)
    return out


def within_distance(df: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """Rows within ``km`` of a point: a box the scan can use, then the exact distance, nearest first."""
    degrees = km / jn.KM_PER_DEGREE
    box = F.col("latitude").between(lat - degrees, lat + degrees)
    if abs(lat) + degrees < 89.0:
        spread = math.degrees(math.asin(min(1.0, math.sin(km / 6371.0) / math.cos(math.radians(lat)))))
        if abs(lon) + spread < 180.0:
            box = box & F.col("longitude").between(lon - spread, lon + spread)
    found = df.filter(box).withColumn("distance_km", haversine_km("latitude", "longitude", F.lit(lat), F.lit(lon)))
    return found.filter(F.col("distance_km") <= km)


# ---- the five risk models -------------------------------------------------------------------

def velocity_risk(df: DataFrame, hot_rows=tl.HOT_ROWS) -> DataFrame:
    linked = jn.with_previous(df, ["latitude", "longitude"], hot_rows)
    km = haversine_km("prev_latitude", "prev_longitude", "latitude", "longitude")
    speed = km / (F.col("gap_seconds") / 3600.0)
    risk = (
        F.when(F.col("gap_seconds").isNull(), 0.0).when(F.col("gap_seconds") <= 0, 1.0)
        .when(speed > 800, 1.0).when(speed > 300, 0.8).when(speed > 100, 0.3).otherwise(0.0)
    )
    return linked.withColumn("velocity_risk", risk).drop("prev_latitude", "prev_longitude", "gap_seconds")


#: Users with fewer rows have all pairs of their rows compared; the places of others are joined by grid cells.
BUSY_ROWS = 500


def location_frequency(df: DataFrame, radius_km: float = 1.0, hot_rows=tl.HOT_ROWS) -> DataFrame:
    """How often the user has been within ``radius_km`` up to and including this transaction, and its risk."""
    hot = hot_rows.hot_rows if isinstance(hot_rows, tl.HotKeys) else hot_rows
    busy = tl.list_hot_keys(df.select("user_id"), "user_id", min(BUSY_ROWS, hot))
    if busy is None:
        own = _visits_by_pairs(df, radius_km)
    else:
        own = _visits_by_pairs(df.join(busy, "user_id", "left_anti"), radius_km).unionByName(
            _visits_by_places(df.join(busy, "user_id", "left_semi"), radius_km, hot)
        )
    n = F.col("nearby_visits")
    return df.join(own, "transaction_id").withColumn("frequency_risk", F.when(n == 1, 0.6).when(n <= 3, 0.3).otherwise(0.0))


def _visits_by_pairs(df: DataFrame, radius_km: float) -> DataFrame:
    """(transaction_id, nearby_visits) of every row, from all pairs of rows of a user; rows without a time come first."""
    keys = ["user_id", "transaction_id", "_us", "latitude", "longitude"]
    placed = df.select("user_id", "transaction_id", micros("ts").alias("_us"), "latitude", "longitude").filter(F.col("user_id").isNotNull())
    rows = placed.repartition("user_id").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    seen = rows.select(*[F.col(c).alias(f"near_{c}") for c in rows.columns if c != "transaction_id"])
    near = (
        (F.col("user_id") == F.col("near_user_id")) & (F.col("near__us").isNull() | (F.col("near__us") <= F.col("_us")))
        & (F.abs(F.col("latitude") - F.col("near_latitude")) <= radius_km / jn.KM_PER_DEGREE + 1e-9)
        & (haversine_km("latitude", "longitude", "near_latitude", "near_longitude") <= radius_km)
    )
    counted = rows.join(seen, near).groupBy(*keys, "_n").agg(F.sum("near__n").alias("nearby_visits"))
    # equal rows are one here, and as many again in the result
    return counted.select("transaction_id", F.explode(F.array_repeat("nearby_visits", F.col("_n").cast("int"))).alias("nearby_visits"))


def _visits_by_places(df: DataFrame, radius_km: float, hot_rows: int) -> DataFrame:
    """The same without all pairs: every distinct place of a user receives the visits of the places around it; a running
    count per place follows."""
    df = df.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    spot = F.struct("latitude", "longitude")
    spots = df.select("user_id", "latitude", "longitude").distinct()
    around = jn.radius_join(spots, spots, radius_km, ["user_id"]).select(
        F.col("user_id"), spot.alias("_place"), F.struct(F.col("near_latitude").alias("latitude"), F.col("near_longitude").alias("longitude")).alias("_seen")
    )
    visits = df.select("user_id", spot.alias("_seen"), micros("ts").alias("_us"), F.col("transaction_id"))
    spread = around.join(visits, ["user_id", "_seen"])
    counted = tl.running_sums(spread, ["user_id", "_place"], F.col("_us"), {"visits": F.lit(1)}, tl.time_slice(F.col("_us")), hot_rows)
    return counted.filter(F.col("_place") == F.col("_seen")).select("transaction_id", F.col("visits").alias("nearby_visits"))


def outlier_risk(df: DataFrame, hot_rows=tl.HOT_ROWS) -> DataFrame:
    """Distance from the centre of the last 10 places against the distances to the last 20."""

    def build(window, seq):
        frame = lambda n: window.rowsBetween(-(n - 1), 0)
        return {
            "_places": F.collect_list(F.struct("latitude", "longitude")).over(frame(20)),
            "_clat": F.avg("latitude").over(frame(10)), "_clon": F.avg("longitude").over(frame(10)), "_rows": seq,
        }

    base = df.withColumn("_us", micros("ts"))
    framed = tl.row_frames(base, "user_id", [F.col("_us"), F.col("transaction_id")], 20, build, tl.time_slice(F.col("_us")), hot_rows)
    before = F.slice("_places", F.lit(1), F.size("_places") - 1)
    far = framed.withColumn("_d", F.transform(before, lambda p: haversine_km(p["latitude"], p["longitude"], "latitude", "longitude")))
    n = F.size("_d")
    mean = F.try_divide(F.aggregate("_d", F.lit(0.0), lambda a, x: a + x), n)
    spread = far.withColumn("_mean", mean).withColumn(
        "_std", F.sqrt(F.try_divide(F.aggregate("_d", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))), n))
    )
    here = haversine_km("_clat", "_clon", "latitude", "longitude")
    risk = (
        F.when(F.col("_rows") < 5, 0.2)
        .when(F.col("_std") > 0, F.least(F.lit(1.0), F.abs(here - F.col("_mean")) / F.col("_std") / 3.0))
        .otherwise(0.0)
    )
    return spread.withColumn("outlier_risk", risk).drop("_us", "_places", "_clat", "_clon", "_rows", "_d", "_mean", "_std")


def cluster_risk(df: DataFrame, clusters: DataFrame) -> DataFrame:
    """Highest risk of the hotspot clusters a row lies in; nearer the centre counts more."""
    spots = clusters.filter(F.col("cluster_type") == "hotspot")
    hits = jn.cluster_join(df.select("transaction_id", "latitude", "longitude"), spots)
    risk = by_level(F.col("cluster_level"), LEVEL_RISK) * (1.0 - F.col("cluster_distance_km") / F.col("radius_km")) * F.col("confidence")
    best = hits.groupBy("transaction_id").agg(F.max(risk).alias("cluster_risk"))
    return df.join(best, "transaction_id", "left").withColumn("cluster_risk", F.greatest(F.coalesce("cluster_risk", F.lit(0.0)), F.lit(0.0)))


def zone_risk(df: DataFrame, zones: DataFrame) -> DataFrame:
    hits = jn.zone_join(df.select("transaction_id", "latitude", "longitude"), zones)
    best = hits.groupBy("transaction_id").agg(F.max(by_level(F.col("risk_level"), LEVEL_RISK)).alias("zone_risk"))
    return df.join(best, "transaction_id", "left").withColumn("zone_risk", F.coalesce("zone_risk", F.lit(0.0)))


WEIGHTS = {"velocity_risk": 0.25, "frequency_risk": 0.2, "outlier_risk": 0.2, "cluster_risk": 0.2, "zone_risk": 0.15}


def location_risk(df: DataFrame, zones: DataFrame, clusters: DataFrame, hot_rows=tl.HOT_ROWS) -> DataFrame:
    """Weighted sum of the five models."""
    hot = tl.HotKeys(df, "user_id", hot_rows=hot_rows)
    parts = [
        velocity_risk(df, hot).select("transaction_id", "velocity_risk"),
        location_frequency(df, hot_rows=hot).select("transaction_id", "frequency_risk"),
        outlier_risk(df, hot).select("transaction_id", "outlier_risk"),
        cluster_risk(df, clusters).select("transaction_id", "cluster_risk"),
        zone_risk(df, zones).select("transaction_id", "zone_risk"),
    ]
    out = df
    for p in parts:
        out = out.join(p, "transaction_id")
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + F.col(name) * weight
    return out.withColumn("geo_risk", F.least(F.lit(1.0), total))


# ---- clusters -------------------------------------------------------------------------------

def grade(df: DataFrame, keys, score: str = "fraud_score") -> DataFrame:
    """Risk grade of row groups from mean risk, user ratio and volume."""
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("transaction_count"), F.avg(score).alias("avg_risk"),
        F.count_distinct("user_id").alias("unique_users"), F.sum("amount").alias("total_amount"),
        F.avg("latitude").alias("center_lat"), F.avg("longitude").alias("center_lon"),
    )
    risk = F.round("avg_risk", 9)  # a mean of partial sums; nine places keep it on one side of a border
    factors = (
        F.when(risk > 0.7, 2).when(risk > 0.5, 1).otherwise(0)
        + F.when(F.col("unique_users") > F.col("transaction_count") * 0.7, 2).otherwise(0)
        + F.when(F.col("total_amount") > 50000, 1).otherwise(0)
    )
    return base.withColumn("_f", factors).withColumns(
        {
            "risk_level": F.when(F.col("_f") >= 4, "critical").when(F.col("_f") >= 3, "high").when(F.col("_f") >= 2, "medium").otherwise("low"),
            "confidence": F.when(F.col("_f") >= 4, 0.9).when(F.col("_f") >= 3, 0.8).when(F.col("_f") >= 2, 0.6).otherwise(0.4),
        }
    ).drop("_f")


def grid_cell(km: float = 1.0) -> dict[str, Column]:
    lat, lon = F.col("latitude"), F.col("longitude")
    return {
        "grid_lat": (lat / F.lit(km / 111.0)).cast("long"),
        "grid_lon": (lon / (F.lit(km) / (F.lit(111.0) * F.cos(F.radians(lat))))).cast("long"),
    }


def grid_clusters(df: DataFrame, km: float = 1.0, min_count: int = 10, seconds: float | None = 86400, as_of=None) -> DataFrame:
    cells = since(df, seconds, as_of).withColumns(grid_cell(km))
    return grade(cells, ["grid_lat", "grid_lon"]).filter(F.col("transaction_count") >= min_count)


def _with_radius(labelled: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    centres = summary.select(key, "center_lat", "center_lon")
    radius = labelled.join(centres, key).groupBy(key).agg(
        F.max(haversine_km("center_lat", "center_lon", "latitude", "longitude")).alias("radius_km")
    )
    return summary.join(radius, key)


def dbscan_labels(df: DataFrame, eps_km: float = 0.5, min_points: int = 5, seconds: float | None = 86400, as_of=None) -> DataFrame:
    points = since(df, seconds, as_of).filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    return cl.dbscan(points.withColumns(cl.sphere_xyz("latitude", "longitude")), cl.chord(eps_km), min_points).drop(*cl.AXES)


def dbscan_clusters(df: DataFrame, eps_km: float = 0.5, min_points: int = 5, seconds: float | None = 86400, as_of=None) -> DataFrame:
    """Clusters with centre, largest distance from it, and risk grade."""
    labelled = cut_lineage(dbscan_labels(df, eps_km, min_points, seconds, as_of).filter(F.col("cluster_id").isNotNull()))
    return _with_radius(labelled, grade(labelled, ["cluster_id"]), "cluster_id")


def hotspots(
    df: DataFrame, min_score: float = 0.7, km: float = 2.0, min_count: int = 5, seconds: float | None = 172_800, as_of=None,
    max_rounds: int = 1000,
) -> DataFrame:
    """Leaders of dense risky neighbourhoods with the figures of everything within ``km``.

    The places with the most neighbours lead first (ties: smallest coordinates); a place in the reach of a leader
    does not lead.  Each round settles every place that beats all open places around it; raises when ``max_rounds`` do not
    suffice.
    """
    risky = since(df, seconds, as_of).filter(F.col("fraud_score") >= min_score)
    spots = cut_lineage(
        jn.places(risky, (), [F.sum("fraud_score").alias("s"), F.sum("amount").alias("a")])
    )
    dense = cut_lineage(
        jn.radius_join(spots.select("latitude", "longitude"), spots, km)
        .groupBy("latitude", "longitude")
        .agg(
            F.sum("near_n").alias("transaction_count"), (F.sum("near_s") / F.sum("near_n")).alias("avg_risk_score"),
            (F.sum(F.col("near_latitude") * F.col("near_n")) / F.sum("near_n")).alias("center_lat"),
            (F.sum(F.col("near_longitude") * F.col("near_n")) / F.sum("near_n")).alias("center_lon"),
        )
        .filter(F.col("transaction_count") >= min_count)
    )
    order = lambda p: F.struct((-F.col(f"{p}transaction_count")).alias("c"), F.col(f"{p}latitude").alias("y"), F.col(f"{p}longitude").alias("x"))
    open_places = dense.select("latitude", "longitude", "transaction_count")
    leaders = None
    for _ in range(max_rounds):
        best = jn.radius_join(open_places, open_places, km).groupBy("latitude", "longitude", "transaction_count").agg(
            F.min(order("near_")).alias("best")
        )
        lead = cut_lineage(best.filter(F.col("best") == order("")).select("latitude", "longitude"))
        leaders = lead if leaders is None else leaders.unionByName(lead)
        covered = jn.radius_join(lead, open_places.select("latitude", "longitude"), km).select(
            F.col("near_latitude").alias("latitude"), F.col("near_longitude").alias("longitude")
        ).distinct()
        open_places = cut_lineage(open_places.join(covered, ["latitude", "longitude"], "left_anti"))
        if open_places.isEmpty():
            break
    else:
        raise RuntimeError(f"places are still open after {max_rounds} rounds")
    return leaders.join(dense, ["latitude", "longitude"]).withColumn("risk_level", F.lit("high"))


def spacetime_labels(df: DataFrame, eps: float = 0.5, min_points: int = 5, seconds: float | None = 259_200, as_of=None) -> DataFrame:
    """Density clusters in standardised kilometres and hours."""
    recent = since(df, seconds, as_of).filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    lat, lon = F.col("latitude"), F.col("longitude")
    scaled = cl.standardised(
        recent, {"_x": lat * 111.0, "_y": lon * 111.0 * F.cos(F.radians(lat)), "_z": micros("ts") / 3.6e9}
    )
    return cl.dbscan(scaled, eps, min_points).drop(*cl.AXES)


def spacetime_clusters(
    df: DataFrame, eps: float = 0.5, min_points: int = 5, seconds: float | None = 259_200, burst_hours: float = 2.0, as_of=None
) -> DataFrame:
    labelled = cut_lineage(spacetime_labels(df, eps, min_points, seconds, as_of).filter(F.col("cluster_id").isNotNull()))
    spans = temporal_pattern(labelled, ["cluster_id"]).select("cluster_id", "duration_hours")
    return _with_radius(labelled, grade(labelled, ["cluster_id"]), "cluster_id").join(spans, "cluster_id").withColumn(
        "cluster_type", F.when(F.col("duration_hours") <= burst_hours, "burst_activity").otherwise("sustained_activity")
    )


def temporal_pattern(df: DataFrame, keys) -> DataFrame:
    """Span, rate, peak hour and hour / weekday histograms of row groups."""
    from ledgerwatch.operators.aggregates import histogram_text

    timed = df.withColumns({"_h": F.hour("ts"), "_w": F.weekday("ts")})
    hours = (micros(F.max("ts")) - micros(F.min("ts"))) / 3.6e9
    base = df.groupBy(*keys).agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), hours.alias("duration_hours"), F.count(F.lit(1)).alias("events")
    ).withColumn("transactions_per_hour", F.col("events") / F.greatest(F.lit(1.0), F.col("duration_hours")))
    peak = timed.groupBy(*keys, "_h").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(
        F.min_by("_h", F.struct(-F.col("_n"), F.col("_h"))).alias("peak_hour")
    )
    return (
        base.join(peak, list(keys)).join(histogram_text(timed, list(keys), "_h", "hour_distribution"), list(keys))
        .join(histogram_text(timed, list(keys), "_w", "weekday_distribution"), list(keys))
    )


# ---- travel ---------------------------------------------------------------------------------

def travel_steps(df: DataFrame, hot_rows=tl.HOT_ROWS) -> DataFrame:
    """Each transaction with the distance, time and speed since the user's previous one."""
    linked = jn.with_previous(df, ["latitude", "longitude", "ts"], hot_rows)
    km = haversine_km("prev_latitude", "prev_longitude", "latitude", "longitude")
    return linked.withColumn("step_km", km).withColumn(
        "speed_kmh", F.when(F.col("gap_seconds") > 0, F.col("step_km") / (F.col("gap_seconds") / 3600.0))
    )


def home_places(df: DataFrame, places: int = 3) -> DataFrame:
    """First visited place inside each user's most visited rounded cell."""
    cell = [F.round("latitude", places).alias("_ry"), F.round("longitude", places).alias("_rx")]
    visits = df.groupBy("user_id", *cell).agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(F.struct("latitude", "longitude"), F.struct("ts", "transaction_id")).alias("_first")
    )
    return visits.groupBy("user_id").agg(
        F.min_by("_first", F.struct(-F.col("_n"), F.col("_ry"), F.col("_rx"))).alias("_home")
    ).select("user_id", F.col("_home.latitude").alias("home_lat"), F.col("_home.longitude").alias("home_lon"))


def travel_patterns(df: DataFrame, hot_rows=tl.HOT_ROWS) -> DataFrame:
    """Home, 95 % travel radius, speeds and alarm threshold of every user."""
    home = home_places(df)
    away = df.select("user_id", "latitude", "longitude").join(home, "user_id").select(
        "user_id", haversine_km("home_lat", "home_lon", "latitude", "longitude").alias("_km")
    )
    radius = tl.exact_quantiles(away, "user_id", "_km", {"travel_radius_km": 0.95})
    speeds = travel_steps(df, hot_rows).groupBy("user_id").agg(F.max("speed_kmh").alias("m"), F.avg("speed_kmh").alias("a"))
    top = F.coalesce("m", F.lit(100.0))
    return home.join(radius, "user_id").join(speeds, "user_id").select(
        "user_id", "home_lat", "home_lon", "travel_radius_km", top.alias("max_km_per_hour"),
        F.coalesce("a", F.lit(25.0)).alias("avg_km_per_hour"), F.greatest(F.lit(500.0), top * 2).alias("anomaly_threshold"),
    )


def frequent_locations(df: DataFrame, km: float = 1.0, k: int = 5, min_visits: int = 2) -> DataFrame:
    """Up to ``k`` most visited cells per user with the visited place nearest to the cell's centroid."""
    celled = df.withColumns(grid_cell(km))
    keys = ["user_id", "grid_lat", "grid_lon"]
    spots = celled.groupBy(*keys, "latitude", "longitude").agg(F.count(F.lit(1)).alias("n"))
    centres = spots.groupBy(*keys).agg(
        F.sum("n").alias("visits"), (F.sum(F.col("latitude") * F.col("n")) / F.sum("n")).alias("_y"),
        (F.sum(F.col("longitude") * F.col("n")) / F.sum("n")).alias("_x"),
    ).filter(F.col("visits") >= min_visits)
    best = tl.top_rows(centres, "user_id", [F.desc("visits"), F.col("grid_lat"), F.col("grid_lon")], k, F.col("grid_lat"), salts=8, rank="place")
    near = F.round(haversine_km("_y", "_x", "latitude", "longitude"), 6)  # to the millimetre, so that ties are ties
    chosen = spots.join(best, keys).groupBy(*keys, "visits", "place").agg(
        F.min_by(F.struct("latitude", "longitude"), F.struct(near, F.col("latitude"), F.col("longitude"))).alias("_p")
    )
    return chosen.select("user_id", "place", "visits", F.col("_p.latitude").alias("latitude"), F.col("_p.longitude").alias("longitude"))


def suspicious_movements(df: DataFrame, patterns: DataFrame, hot_rows=tl.HOT_ROWS) -> DataFrame:
    """Steps beyond the user's threshold (or two places at the same time), with details."""
    steps = travel_steps(df, hot_rows).join(patterns.select("user_id", "anomaly_threshold"), "user_id")
    together = (F.col("gap_seconds") <= 0) & (F.col("step_km") > 0)
    return steps.filter(together | (F.col("speed_kmh") > F.col("anomaly_threshold"))).select(
        "transaction_id", "user_id", "step_km", "gap_seconds", "speed_kmh", "anomaly_threshold", "prev_latitude", "prev_longitude", "prev_ts"
    )


def velocity_profile(
    df: DataFrame, alpha: float = 0.1, rows: int = 20, start: tuple[float, float] = (100.0, 25.0), hot_rows=tl.HOT_ROWS
) -> DataFrame:
    """Smoothed maximum and mean speed over the last ``rows`` steps, after every transaction."""
    hot = hot_rows if isinstance(hot_rows, tl.HotKeys) else tl.HotKeys(df, "user_id", hot_rows=hot_rows)
    steps = hot.settle(travel_steps(df.select("transaction_id", "user_id", "ts", "latitude", "longitude"), hot))

    def recent(window, seq):
        frame = window.rowsBetween(-(rows - 1), 0)
        return {"_max": F.max("speed_kmh").over(frame), "_avg": F.avg("speed_kmh").over(frame)}

    def smooth(window, seq):
        frame = window.rowsBetween(-(wn.ema_rows(alpha) - 1), 0)
        return {
            name: F.aggregate(F.collect_list(c).over(frame), F.lit(first), lambda a, x: a * (1 - alpha) + x * alpha)
            for name, c, first in (("profile_max", "_max", start[0]), ("profile_avg", "_avg", start[1]))
        }

    order = [F.col("_us"), F.col("transaction_id")]
    base = steps.withColumn("_us", micros("ts"))
    slices = tl.time_slice(F.col("_us"))
    latest = hot.settle(tl.row_frames(base, "user_id", order, rows, recent, slices, hot))
    return tl.row_frames(latest, "user_id", order, wn.ema_rows(alpha), smooth, slices, hot).select(
        "transaction_id", "user_id", "speed_kmh", "profile_max", "profile_avg"
    )


# ---- lookups --------------------------------------------------------------------------------

def location_scores(points: DataFrame, zones: DataFrame, clusters: DataFrame) -> DataFrame:
    """Risk of places ``(transaction_id, latitude, longitude)``: the worst zone, else the nearest hotspot, else 0.1."""
    spots = points.select("transaction_id", "latitude", "longitude")
    in_zone = jn.zone_join(spots, zones).groupBy("transaction_id").agg(F.max(by_level(F.col("risk_level"), LEVEL_RISK)).alias("_z"))
    hits = jn.cluster_join(spots, clusters.filter(F.col("cluster_type") == "hotspot"), reach=2.0)
    nearness = F.greatest(F.lit(0.0), 1.0 - F.col("cluster_distance_km") / (F.col("radius_km") * 2.0))
    risk = by_level(F.col("cluster_level"), LOCATION_RISK) * nearness * F.col("confidence")
    nearest = hits.groupBy("transaction_id").agg(F.min_by(risk, F.struct("cluster_distance_km", "cluster_id")).alias("_c"))
    return spots.join(in_zone, "transaction_id", "left").join(nearest, "transaction_id", "left").select(
        "transaction_id", F.coalesce("_z", "_c", F.lit(0.1)).alias("location_risk")
    )


def area_statistics(df: DataFrame, probes: DataFrame, radius_km: float) -> DataFrame:
    """Figures of everything within ``radius_km`` of each probe ``(probe_id, latitude, longitude)``."""
    near = jn.radius_join(probes, df, radius_km)
    hours = (micros(F.max("near_ts")) - micros(F.min("near_ts"))) / 3.6e9
    facts = near.groupBy("probe_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("near_fraud_score").alias("s"), F.count_distinct("near_user_id").alias("u"),
        F.count_distinct("near_merchant_id").alias("m"), F.sum("near_amount").alias("a"), hours.alias("h"),
    )
    zero, none = F.lit(0), F.lit(0.0)
    return probes.select("probe_id").join(facts, "probe_id", "left").select(
        "probe_id", F.coalesce("n", zero).alias("transaction_count"), F.coalesce("s", none).alias("avg_risk_score"),
        F.coalesce("u", zero).alias("unique_users"), F.coalesce("m", zero).alias("unique_merchants"),
        F.coalesce("a", none).alias("total_amount"), F.coalesce("h", none).alias("time_span_hours"),
        F.coalesce(F.col("n") / F.greatest(F.lit(1.0), F.col("h")), none).alias("transactions_per_hour"),
    )


def map_extract(df: DataFrame, clusters: DataFrame, zones: DataFrame, lat: float, lon: float, km: float = 10.0) -> dict[str, DataFrame]:
    """Transactions, clusters and zones within ``km`` of a point."""
    centre = zones.withColumns(
        {
            "latitude": F.aggregate("ring", F.lit(0.0), lambda a, p: a + p["lat"]) / F.size("ring"),
            "longitude": F.aggregate("ring", F.lit(0.0), lambda a, p: a + p["lon"]) / F.size("ring"),
        }
    )
    middle = clusters.withColumnsRenamed({"cluster_lat": "latitude", "cluster_lon": "longitude"})
    return {"transactions": within_distance(df, lat, lon, km), "clusters": within_distance(middle, lat, lon, km), "zones": within_distance(centre, lat, lon, km)}
