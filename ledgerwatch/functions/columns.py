"""Column helpers: each takes and returns Columns and stays inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
DAY_SECONDS = 86_400
HOUR_SECONDS = 3_600


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- time -----------------------------------------------------------------------------------

def micros(ts) -> Column:
    """Timestamp as microseconds since the epoch, the unit of every range frame."""
    return F.unix_micros(col(ts))


def seconds_between(later, earlier) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1_000_000.0)


def interval_before(ts: Column, seconds: float) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) - F.lit(int(seconds * 1_000_000)))


def weekday_monday0(ts) -> Column:
    return F.weekday(col(ts))


def weekday_sunday0(ts) -> Column:
    return F.dayofweek(col(ts)) - 1


def truncate(unit: str, ts) -> Column:
    return F.date_trunc(unit, col(ts))


def time_bucket(width_seconds: int, ts) -> Column:
    """Start of the epoch-aligned bucket that holds ``ts``."""
    width = F.lit(int(width_seconds) * 1_000_000)
    m = micros(ts)
    return F.timestamp_micros(m - F.pmod(m, width))


def parse_iso(text) -> Column:
    return F.try_to_timestamp(F.regexp_replace(col(text).cast("string"), "Z$", "+00:00"))


# ---- numbers --------------------------------------------------------------------------------

def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def safe_ratio(numerator: Column, denominator: Column, default=0.0) -> Column:
    """Quotient, or ``default`` where the denominator is zero or missing."""
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(default))


def by_mean(column: str) -> Column:
    """Descending order by a mean, at nine places: partial sums arrive in any order, and equal means must tie."""
    return F.desc_nulls_last(F.round(F.col(column), 9))


def flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def log2(value: Column) -> Column:
    return F.log(value) / F.lit(math.log(2.0))


def entropy_of_counts(counts: Column) -> Column:
    """Shannon entropy (bits) of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, n: a + n)
    return F.aggregate(
        counts, F.lit(0.0), lambda a, n: a - F.when(n > 0, n / total * log2(n / total)).otherwise(F.lit(0.0))
    )


# ---- hashes and text ------------------------------------------------------------------------

def content_key(*columns) -> Column:
    """Stable SHA-256 id of the given columns."""
    return F.sha2(F.to_json(F.struct(*[col(c) for c in columns])), 256)


def hash_fraction(*columns, seed: int = 0) -> Column:
    """A reproducible number in [0, 1) derived from the columns and the seed."""
    h = F.xxhash64(*[col(c).cast("string") for c in columns], F.lit(seed))
    return F.pmod(h, F.lit(1 << 52)) / F.lit(float(1 << 52))


def contains_any(text: Column, words) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return F.coalesce(found, F.lit(False))


def present(*conditions_and_labels) -> Column:
    """Array of the labels whose condition holds, in the given order."""
    marks = F.array(*[F.when(c, F.lit(label)) for c, label in conditions_and_labels])
    return F.filter(marks, lambda m: m.isNotNull())


# ---- geography ------------------------------------------------------------------------------

def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a1, o1, a2, o2 = (F.radians(col(c)) for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


#: Fixed value: the geohash base-32 alphabet.
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(lat, lon, precision: int = 7) -> Column:
    """Geohash by bit interleaving: integer cell numbers per axis, five bits per character."""
    bits = 5 * precision
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2

    def cell(value: Column, low: float, span: float, n: int) -> Column:
        raw = F.floor((value - F.lit(low)) / F.lit(span) * F.lit(float(1 << n))).cast("long")
        return F.greatest(F.lit(0).cast("long"), F.least(F.lit((1 << n) - 1).cast("long"), raw))

    x, y = cell(col(lon), -180.0, 360.0, lon_bits), cell(col(lat), -90.0, 180.0, lat_bits)
    letters = []
    for k in range(precision):
        index = F.lit(0).cast("long")
        for b in range(5):
            position = 5 * k + b
            source, width = (x, lon_bits) if position % 2 == 0 else (y, lat_bits)
            bit = F.shiftright(source, width - 1 - position // 2).bitwiseAND(F.lit(1).cast("long"))
            index = index + bit * F.lit(1 << (4 - b))
        letters.append(F.substring(F.lit(GEOHASH_ALPHABET), index.cast("int") + F.lit(1), F.lit(1)))
    return F.when(col(lat).isNotNull() & col(lon).isNotNull(), F.concat(*letters))


def inside_polygon(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd test against ``array<struct<lat,lon>>``; the ring need not be closed."""
    n = F.size(ring)
    edges = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            F.get(ring, i)["lat"].alias("ay"),
            F.get(ring, i)["lon"].alias("ax"),
            F.get(ring, F.pmod(i + 1, n))["lat"].alias("by"),
            F.get(ring, F.pmod(i + 1, n))["lon"].alias("bx"),
        ),
    )
    crossings = F.aggregate(
        edges,
        F.lit(0),
        lambda acc, e: acc
        + F.when(
            ((e["ay"] > lat) != (e["by"] > lat))
            & (lon < (e["bx"] - e["ax"]) * (lat - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]),
            1,
        ).otherwise(0),
    )
    return F.when(n >= 3, F.pmod(crossings, F.lit(2)) == 1).otherwise(F.lit(False))


# ---- JSON -----------------------------------------------------------------------------------

def json_field(text, path: str, kind: str = "double") -> Column:
    return F.get_json_object(col(text), f"$.{path}").try_cast(kind)


def row_json(*columns) -> Column:
    return F.to_json(F.struct(*[col(c) for c in columns]))
