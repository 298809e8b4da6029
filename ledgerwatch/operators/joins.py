"""Joins.  Dimension joins carry no broadcast hint: Spark's size check and AQE choose, and AQE splits hot keys."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions import timeline as tl
from ledgerwatch.functions.columns import EARTH_KM, col, haversine_km, inside_polygon, micros
from ledgerwatch.operators.common import since

KM_PER_DEGREE = math.pi * EARTH_KM / 180.0


def with_merchant(df: DataFrame, merchants: DataFrame, default_risk: float | None = None) -> DataFrame:
    """Left join the merchant dimension; a missing risk becomes ``default_risk`` where one is given."""
    joined = df.join(merchants, "merchant_id", "left")
    if default_risk is None:
        return joined
    return joined.withColumn("merchant_risk", F.coalesce("merchant_risk", F.lit(default_risk)))


def merchant_activity(df: DataFrame, merchants: DataFrame, seconds: float, as_of=None) -> DataFrame:
    """Merchants with their recent transactions (the time test makes the outer join an inner one)."""
    return merchants.join(since(df, seconds, as_of), "merchant_id")


def top_risk_merchants(
    df: DataFrame, merchants: DataFrame, seconds: float = 30 * 86400, min_count: int = 10, k: int = 100, as_of=None
) -> DataFrame:
    """Merchants with more than ``min_count`` recent transactions, by risk and fraud count."""
    facts = since(df, seconds, as_of).groupBy("merchant_id").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum("amount").alias("transaction_volume"),
        F.count_if("is_fraud").alias("fraud_count"),
        F.avg("fraud_score").alias("avg_fraud_score"),
    )
    return (
        merchants.join(facts, "merchant_id", "left")
        .filter(F.col("transaction_count") > min_count)
        .orderBy(F.desc("merchant_risk"), F.desc("fraud_count"), "merchant_id")
        .limit(k)
    )


def shared_device_members(df: DataFrame, users: DataFrame, min_risk: float = 0.5, min_users: int = 2) -> DataFrame:
    """Risky users that share a device with another risky user.

    One row per (device, user) with the number of partners and the device's mean risk: the same facts as the list of
    user pairs, but linear in the number of users of a device.
    """
    members = (
        df.select("device_id", "user_id").filter(F.col("device_id").isNotNull()).distinct()
        .join(users.select("user_id", "risk_score").filter(F.col("risk_score") > min_risk), "user_id")
    )
    rings = members.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("user_count"), F.avg("risk_score").alias("avg_risk_score")
    ).filter(F.col("user_count") >= min_users)
    return members.join(rings, "device_id").withColumn("partners", F.col("user_count") - 1)


def suspicious_paths(
    df: DataFrame, merchants: DataFrame, min_score: float = 0.7, min_merchant_risk: float = 0.5
) -> DataFrame:
    """User → transaction → merchant paths with score filters: per user totals, one row per merchant name."""
    paths = df.filter(F.col("fraud_score") > min_score).join(
        merchants.filter(F.col("merchant_risk") > min_merchant_risk), "merchant_id"
    )
    per_pair = paths.groupBy("user_id", "merchant_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("fraud_score").alias("s")
    )
    per_user = per_pair.groupBy("user_id").agg(
        F.sum("n").alias("suspicious_transactions"), (F.sum("s") / F.sum("n")).alias("avg_fraud_score")
    )
    return per_pair.select("user_id", "merchant_name", F.col("n").alias("merchant_transactions")).join(per_user, "user_id")


def with_optional_parties(df: DataFrame, users: DataFrame, merchants: DataFrame) -> DataFrame:
    """All transactions, with user and merchant attributes where those exist."""
    return df.join(users.select("user_id", "risk_score"), "user_id", "left").join(
        merchants.select("merchant_id", "merchant_name"), "merchant_id", "left"
    )


def with_group_stats(df: DataFrame, key: str, value: str, prefix: str = "group") -> DataFrame:
    """Group statistics merged back onto the rows: aggregate first (map-side), then join."""
    stats = df.groupBy(key).agg(
        F.count(F.lit(1)).alias(f"{prefix}_count"),
        F.avg(value).alias(f"{prefix}_mean"),
        F.stddev_samp(value).alias(f"{prefix}_std"),
        F.min(value).alias(f"{prefix}_min"),
        F.max(value).alias(f"{prefix}_max"),
    )
    return tl.null_safe_join(df, stats, [key])


def with_previous(df: DataFrame, columns: Sequence[str], hot_rows=tl.HOT_ROWS) -> DataFrame:
    """Latest earlier transaction of the same user: columns ``prev_*`` and the gap in seconds."""
    base = df.withColumn("_us", micros("ts"))
    linked = tl.neighbours(
        base, "user_id", ["_us", "transaction_id"], tl.time_slice(F.col("_us")),
        previous={"_prev_us": F.col("_us"), **{f"prev_{c}": F.col(c) for c in columns}}, hot_rows=hot_rows,
    )
    return linked.withColumn("gap_seconds", (F.col("_us") - F.col("_prev_us")) / 1e6).drop("_us", "_prev_us")


def location_links(
    df: DataFrame, cell_degrees: float = 0.5, min_score: float = 0.5, k: int | None = 50
) -> DataFrame:
    """Pairs of places that one user visited with risky transactions.

    Rows are first reduced to one per (user, cell), so a user adds at most one row per pair of *places*, whatever
    the number of transactions; the cell size bounds the places.
    """
    risky = df.filter(F.col("fraud_score") > min_score)
    per_place = risky.groupBy(
        "user_id",
        F.floor(F.col("latitude") / cell_degrees).alias("y"),
        F.floor(F.col("longitude") / cell_degrees).alias("x"),
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("fraud_score").alias("s"))
    a, b = (
        per_place.select("user_id", *[F.col(c).alias(f"{side}_{c}") for c in ("y", "x", "n", "s")])
        for side in ("from", "to")
    )
    before = (F.col("from_y") < F.col("to_y")) | ((F.col("from_y") == F.col("to_y")) & (F.col("from_x") < F.col("to_x")))
    pairs = a.join(b, "user_id").filter(before)
    combos = F.col("from_n") * F.col("to_n")
    links = pairs.groupBy("from_y", "from_x", "to_y", "to_x").agg(
        F.sum(combos).alias("connection_strength"),
        (F.sum(F.col("from_s") * F.col("to_n") + F.col("to_s") * F.col("from_n")) / F.sum(combos) / 2).alias("avg_fraud_score"),
        F.count(F.lit(1)).alias("shared_users"),
    )
    ordered = links.orderBy(F.desc("connection_strength"), "from_y", "from_x", "to_y", "to_x")
    return ordered if k is None else ordered.limit(k)


def merchant_statistics(df: DataFrame, merchants: DataFrame) -> DataFrame:
    facts = df.groupBy("merchant_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("s"), F.avg("amount").alias("m"),
        F.count_if("is_fraud").alias("f"),
    )
    zero = F.lit(0)
    return merchants.select("merchant_id").join(facts, "merchant_id", "left").select(
        "merchant_id",
        F.coalesce("n", zero).alias("transaction_count"),
        F.coalesce("s", F.lit(0.0)).alias("total_volume"),
        F.coalesce("m", F.lit(0.0)).alias("avg_transaction_amount"),
        F.coalesce(F.col("f") / F.col("n"), F.lit(0.0)).alias("fraud_rate"),
    )


def user_statistics(df: DataFrame, users: DataFrame) -> DataFrame:
    facts = df.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("s"), F.avg("amount").alias("m"),
        F.count_if("is_fraud").alias("f"), F.avg("fraud_score").alias("r"), F.max("ts").alias("last_transaction_at"),
    )
    zero = F.lit(0)
    return users.select("user_id").join(facts, "user_id", "left").select(
        "user_id",
        F.coalesce("n", zero).alias("total_transactions"),
        F.coalesce("s", F.lit(0.0)).alias("total_amount"),
        F.coalesce("m", F.lit(0.0)).alias("avg_transaction_amount"),
        F.coalesce("f", zero).alias("fraud_incidents"),
        F.coalesce("r", F.lit(0.0)).alias("risk_score"),
        "last_transaction_at",
    )


# ---- distance join --------------------------------------------------------------------------

def _band(lat: Column, degrees: float) -> Column:
    return F.floor((lat + 90.0) / degrees).cast("long")


def _band_cells(band: Column, degrees: float) -> Column:
    """Number of longitude cells of a latitude band: each at least one radius wide at the band's widest latitude."""
    edge = F.greatest(F.abs(band * degrees - 90.0), F.abs((band + 1) * degrees - 90.0))
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(F.least(edge, F.lit(90.0)))) / degrees)).cast("long")


def _lon_cell(lon: Column, cells: Column) -> Column:
    return F.floor((lon + 180.0) / (F.lit(360.0) / cells)).cast("long")


def radius_cells(lat, lon, radius_km: float) -> Column:
    """Struct (band, cell) of the point's own cell."""
    degrees = radius_km / KM_PER_DEGREE
    band = _band(col(lat), degrees)
    cells = _band_cells(band, degrees)
    return F.struct(band.alias("band"), F.pmod(_lon_cell(col(lon), cells), cells).alias("cell"))


def radius_reach(lat, lon, radius_km: float) -> Column:
    """Array of every (band, cell) that can hold a point within the radius, across poles and the antimeridian."""
    degrees = radius_km / KM_PER_DEGREE
    la, lo = col(lat), col(lon)
    ratio = math.sin(min(radius_km / EARTH_KM, math.pi / 2)) / F.greatest(F.cos(F.radians(la)), F.lit(1e-12))
    polar = F.abs(la) + degrees >= 90.0
    spread = F.when(polar | (ratio >= 1.0), F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) + 1e-9)
    home = _band(la, degrees)
    last = F.lit(int(math.floor(180.0 / degrees)))

    def cells_of(band: Column) -> Column:
        cells = _band_cells(band, degrees)
        first, final = _lon_cell(lo - spread, cells), _lon_cell(lo + spread, cells)
        final = F.least(final, first + cells - 1)
        return F.transform(
            F.sequence(first, final), lambda c: F.struct(band.alias("band"), F.pmod(c, cells).alias("cell"))
        )

    bands = F.sequence(F.greatest(home - 1, F.lit(0).cast("long")), F.least(home + 1, last.cast("long")))
    return F.array_distinct(F.flatten(F.transform(bands, cells_of)))


def radius_join(
    left: DataFrame, right: DataFrame, radius_km: float, on: Sequence[str] = (), lat: str = "latitude",
    lon: str = "longitude", prefix: str = "near_",
) -> DataFrame:
    """Pairs within ``radius_km`` (and equal ``on`` columns); columns of ``right`` get the prefix.

    An equi-join on grid cells followed by the exact distance test.  Join one side down to distinct places before
    calling this on dense data; see :func:`radius_counts`.
    """
    probes = left.withColumn("_reach", F.explode(radius_reach(lat, lon, radius_km)))
    points = right.select(*[F.col(c).alias(f"{prefix}{c}") for c in right.columns]).withColumn(
        "_at", radius_cells(f"{prefix}{lat}", f"{prefix}{lon}", radius_km)
    )
    condition = (F.col("_reach.band") == F.col("_at.band")) & (F.col("_reach.cell") == F.col("_at.cell"))
    for c in on:
        condition = condition & (F.col(c) == F.col(f"{prefix}{c}"))
    distance = haversine_km(lat, lon, f"{prefix}{lat}", f"{prefix}{lon}")
    return (
        probes.join(points, condition).withColumn("distance_km", distance)
        .filter(F.col("distance_km") <= radius_km).drop("_reach", "_at")
    )


def places(df: DataFrame, keys: Sequence[str] = (), measures: Sequence[Column] = (), lat="latitude", lon="longitude"):
    """Distinct places with their number of rows: repeats of one point cost one row in a distance join."""
    return df.groupBy(*keys, lat, lon).agg(F.count(F.lit(1)).alias("n"), *measures)


def radius_counts(df: DataFrame, radius_km: float, on: Sequence[str] = ()) -> DataFrame:
    """Rows within the radius of each row's place (itself included), as ``nearby`` on every distinct place."""
    spots = places(df, on)
    pairs = radius_join(spots.drop("n"), spots, radius_km, on)
    return pairs.groupBy(*on, "latitude", "longitude").agg(F.sum("near_n").alias("nearby"))


def nearby_transactions(df: DataFrame, probes: DataFrame, radius_km: float, on: Sequence[str] = ()) -> DataFrame:
    """Transactions within the radius of each probe point."""
    return radius_join(probes, df, radius_km, on)


def zone_join(df: DataFrame, zones: DataFrame, cell_degrees: float = 1.0) -> DataFrame:
    """Rows inside a zone polygon: zones spread over the grid cells of their bounding box, then the exact test.

    ``zones``: zone_id, risk_level, ring ``array<struct<lat,lon>>``.
    """
    box = zones.withColumns(
        {
            "_south": F.array_min(F.transform("ring", lambda p: p["lat"])),
            "_north": F.array_max(F.transform("ring", lambda p: p["lat"])),
            "_west": F.array_min(F.transform("ring", lambda p: p["lon"])),
            "_east": F.array_max(F.transform("ring", lambda p: p["lon"])),
        }
    )

    def cell(c):
        return F.floor(c / cell_degrees).cast("long")

    spread = box.withColumn("_y", F.explode(F.sequence(cell(F.col("_south")), cell(F.col("_north"))))).withColumn(
        "_x", F.explode(F.sequence(cell(F.col("_west")), cell(F.col("_east"))))
    )
    points = df.withColumns({"_py": cell(F.col("latitude")), "_px": cell(F.col("longitude"))})
    joined = points.join(spread, (F.col("_py") == F.col("_y")) & (F.col("_px") == F.col("_x")))
    lat, lon = F.col("latitude"), F.col("longitude")
    inside = joined.filter(
        lat.between(F.col("_south"), F.col("_north")) & lon.between(F.col("_west"), F.col("_east"))
    ).filter(inside_polygon(lat, lon, F.col("ring")))
    return inside.drop("_py", "_px", "_y", "_x", "_south", "_north", "_west", "_east", "ring")


def cluster_join(df: DataFrame, clusters: DataFrame, reach: float = 1.0) -> DataFrame:
    """Rows and the clusters whose centre is within ``reach`` times the cluster radius.

    ``clusters``: cluster_id, cluster_lat, cluster_lon, radius_km, cluster_level, confidence.  A cluster is put on the
    cells of the smallest size class that holds its radius, a row on its own cell of every class in use: one scan and one
    equi-join whatever the mix of radii.  Which of the few classes are in use is asked of the clusters first.
    """
    size = F.col("radius_km") * reach
    kind, spread, own = F.lit(len(RADIUS_CLASSES) - 1), None, []
    for i, km in reversed(list(enumerate(RADIUS_CLASSES))):
        kind = F.when(size <= km, F.lit(i)).otherwise(kind)
    used = {r[0] for r in clusters.select(kind.alias("c")).distinct().collect()}
    if not used:
        used = {0}
    for i, km in enumerate(RADIUS_CLASSES):
        if i not in used:
            continue
        cells = radius_reach("cluster_lat", "cluster_lon", km)
        spread = F.when(F.col("_class") == i, cells) if spread is None else spread.when(F.col("_class") == i, cells)
        at = radius_cells("latitude", "longitude", km)
        own.append(F.struct(F.lit(i).alias("class"), at["band"].alias("band"), at["cell"].alias("cell")))
    placed = clusters.withColumn("_class", kind).withColumn("_reach", F.explode(spread))
    points = df.withColumn("_at", F.explode(F.array(*own)))
    met = (
        (F.col("_at.class") == F.col("_class")) & (F.col("_at.band") == F.col("_reach.band"))
        & (F.col("_at.cell") == F.col("_reach.cell"))
    )
    return (
        points.join(placed, met)
        .withColumn("cluster_distance_km", haversine_km("latitude", "longitude", "cluster_lat", "cluster_lon"))
        .filter(F.col("cluster_distance_km") <= size)
        .drop("_at", "_reach", "_class")
    )


# Size classes of cluster radii in kilometres; the last one spans the globe.
RADIUS_CLASSES = [0.25, 1.0, 4.0, 16.0, 64.0, 256.0, 1024.0, 20100.0]
