"""Ordered per-key computations that never put a whole hot key into one task.

A plain ``Window.partitionBy(key)`` sorts all rows of a key in one task, so a key that holds a large share of the
table decides the run time.  Every helper here first counts the rows per key (one narrow column, combined map-side)
and lists all keys with at least ``hot_rows`` rows.  Which plan a key gets changes nothing about its values but the order
in which doubles are added: no sum is taken as a difference, and none changes its type.

* No hot key: the helper is an ordinary window over one shuffle.
* Hot keys: only those are cut into slices of their order.  Work runs per (key, slice); what must cross a slice border
  (a running sum, the last row) is carried by a second window over one summary row per slice.

Pass a :class:`HotKeys` in place of the number to reuse one counting pass over several steps.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.session import cut_lineage
from ledgerwatch.sources.files import written

HOT_ROWS = 1_000_000
#: Up to so many hot keys are broadcast as a local list; more stay a table, which is joined as Spark sees fit.
BROADCAST_HOT = 10_000
SLICE_SECONDS = 3_600
BLOCK_ROWS = 200_000
#: A range frame adds all its rows again for every row; keys with a stretch as long as a range that holds more rows than this
#: get their trailing sums from slices.
DENSE_ROWS = 500
#: A range is put together from at least so many slices where they would else be shorter than ``slice_seconds``.
RANGE_SLICES = 32

HOT, SLICE = "_hot", "_slice"


def _names(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal or both-missing keys; the right side's key columns are dropped."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = None
    for k in keys:
        part = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        condition = part if condition is None else condition & part
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def list_hot_keys(df: DataFrame, key, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The keys with at least ``hot_rows`` rows, or None; a local table with a broadcast hint while they are few."""
    keys = _names(key)
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= hot_rows)
    return _listed(counted.select(*keys))


def _listed(found: DataFrame) -> DataFrame | None:
    rows = found.limit(BROADCAST_HOT + 1).collect()
    if len(rows) > BROADCAST_HOT:
        return cut_lineage(found)
    return F.broadcast(found.sparkSession.createDataFrame(rows, found.schema)) if rows else None


def list_dense_keys(df: DataFrame, key, micros: Column, length: int, hot_rows: int = HOT_ROWS, dense_rows: int | None = None) -> DataFrame | None:
    """As list_hot_keys(), with the keys that have more than ``dense_rows`` rows in one stretch of ``length`` microseconds."""
    keys = _names(key)
    stretches = df.groupBy(*keys, F.floor(micros / F.lit(max(1, length))).alias(SLICE)).agg(F.count(F.lit(1)).alias("_n"))
    dense = F.max(F.when(F.col(SLICE).isNotNull(), F.col("_n"))) > (DENSE_ROWS if dense_rows is None else dense_rows)
    return _listed(stretches.groupBy(*keys).agg(F.coalesce(dense, F.lit(False)).alias("_d"), F.sum("_n").alias("_n")).filter(F.col("_d") | (F.col("_n") >= hot_rows)).select(*keys))


class HotKeys:
    """Hot keys of one table for several key columns, found once."""

    def __init__(self, df: DataFrame, *keys, hot_rows: int = HOT_ROWS):
        self.hot_rows = hot_rows
        self.found = {tuple(_names(k)): list_hot_keys(df, k, hot_rows) for k in keys}

    def of(self, df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
        """Hot keys for ``keys``; none if a part of the key is known to have none."""
        name = tuple(keys)
        if name not in self.found:
            quiet = any(set(k) <= set(name) and v is None for k, v in self.found.items())
            self.found[name] = None if quiet else list_hot_keys(df, keys, self.hot_rows)
        return self.found[name]

    def dense(self, df: DataFrame, keys: Sequence[str], micros: Column, length: int) -> DataFrame | None:
        """Keys that are hot, or dense over ``length``; one counting pass per key and length."""
        name = (*keys, length)
        if name not in self.found:
            self.found[name] = list_dense_keys(df, keys, micros, length, self.hot_rows)
        return self.found[name]

    def settle(self, df: DataFrame) -> DataFrame:
        """Cut the lineage between steps where hot keys make the plans branch."""
        return cut_lineage(df) if any(v is not None for v in self.found.values()) else df


def _hot(df: DataFrame, keys: Sequence[str], hot_rows) -> DataFrame | None:
    return hot_rows.of(df, keys) if isinstance(hot_rows, HotKeys) else list_hot_keys(df, keys, hot_rows)


def _mark(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    return null_safe_join(df, hot.withColumn(HOT, F.lit(True)), keys).withColumn(HOT, F.coalesce(F.col(HOT), F.lit(False)))


def _cut(df: DataFrame, keys: Sequence[str], slice_of: Column, hot: DataFrame) -> DataFrame:
    """Add ``_hot`` and ``_slice``; ``slice_of`` must grow with the order of the rows."""
    return _mark(df, keys, hot).withColumn(
        SLICE, F.when(F.col(HOT), slice_of.cast("long")).otherwise(F.lit(0).cast("long"))
    )


def time_slice(micros: Column, seconds: int = SLICE_SECONDS) -> Column:
    return F.floor(micros / F.lit(seconds * 1_000_000))


def running_sums(
    df: DataFrame, key, order: Column, measures: dict[str, Column], slice_of: Column, hot_rows=HOT_ROWS,
    all_hot: bool = False,
) -> DataFrame:
    """Add inclusive running sums of ``measures`` per key; rows with equal ``order`` share one value.

    ``all_hot`` skips the counting pass and slices every key.
    """
    keys = _names(key)
    zero = F.lit(0)
    if all_hot:
        rows = df.withColumn(HOT, F.lit(True)).withColumn(SLICE, slice_of.cast("long"))
    else:
        hot = _hot(df, keys, hot_rows)
        if hot is None:
            whole = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
            return df.select("*", *[F.coalesce(F.sum(m).over(whole), zero).alias(n) for n, m in measures.items()])
        rows = _cut(df, keys, slice_of, hot)
    inner = Window.partitionBy(*keys, SLICE).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    summed = rows.select("*", *[F.sum(m).over(inner).alias(n) for n, m in measures.items()])
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    per_slice = (
        rows.filter(HOT)
        .groupBy(*keys, SLICE)
        .agg(*[F.sum(m).alias(f"_c_{n}") for n, m in measures.items()])
        .select(*keys, SLICE, *[F.sum(f"_c_{n}").over(before).alias(f"_c_{n}") for n in measures])
    )
    joined = null_safe_join(summed, per_slice, [*keys, SLICE])
    return joined.select(
        *df.columns,
        *[(F.coalesce(F.col(n), zero) + F.coalesce(F.col(f"_c_{n}"), zero)).alias(n) for n in measures],
    )


def neighbours(
    df: DataFrame,
    key,
    order: Sequence[str],
    slice_of: Column,
    previous: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
    hot_rows=HOT_ROWS,
) -> DataFrame:
    """Add values of the row before and / or after in the order of each key (null at the ends)."""
    keys = _names(key)
    previous, following = previous or {}, following or {}
    order_cols = [F.col(c) for c in order]
    hot = _hot(df, keys, hot_rows)
    if hot is None:
        whole = Window.partitionBy(*keys).orderBy(*order_cols)
        return df.select(
            "*",
            *[F.lag(c).over(whole).alias(n) for n, c in previous.items()],
            *[F.lead(c).over(whole).alias(n) for n, c in following.items()],
        )
    rows = _cut(df, keys, slice_of, hot)
    inner = Window.partitionBy(*keys, SLICE).orderBy(*order_cols)
    outer = Window.partitionBy(*keys).orderBy(SLICE)
    position = F.struct(*order_cols)
    wide = rows
    summaries, carried = [], []
    for names, shift, edge, tag in (
        (previous, F.lag, F.max_by, "_p"),
        (following, F.lead, F.min_by, "_f"),
    ):
        if not names:
            continue
        packed = F.struct(*[c.alias(n) for n, c in names.items()])
        wide = wide.withColumn(f"{tag}_in", shift(packed).over(inner))
        summaries.append(edge(packed, position).alias(f"{tag}_edge"))
        carried.append(shift(f"{tag}_edge").over(outer).alias(f"{tag}_out"))
    per_slice = rows.filter(HOT).groupBy(*keys, SLICE).agg(*summaries).select(*keys, SLICE, *carried)
    joined = null_safe_join(wide, per_slice, [*keys, SLICE])
    out = [F.col(c) for c in df.columns]
    for names, tag in ((previous, "_p"), (following, "_f")):
        if names:
            picked = F.coalesce(F.col(f"{tag}_in"), F.col(f"{tag}_out"))
            out += [picked[n].alias(n) for n in names]
    return joined.select(*out)


def row_frames(
    df: DataFrame,
    key,
    order: Sequence[Column],
    size: int,
    build: Callable[[Window, Column], dict[str, Column]],
    slice_of: Column,
    hot_rows=HOT_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Columns over the last ``size`` rows of each key.

    ``build`` receives the ordered window (without a frame) and the column that holds the row number, and returns
    columns that look back at most ``size - 1`` rows.  Hot keys are numbered by slices and then cut into blocks of
    ``block_rows`` rows, each preceded by a copy of the last ``size - 1`` rows of the block before.
    """
    keys = _names(key)
    hot = _hot(df, keys, hot_rows)
    if hot is None:
        whole = Window.partitionBy(*keys).orderBy(*order)
        numbered = df.withColumn("_seq", F.row_number().over(whole).cast("long"))
        built = build(whole, F.col("_seq"))
        return numbered.select("*", *[c.alias(n) for n, c in built.items()]).drop("_seq")
    block_rows = max(block_rows, size)
    rows = _cut(df, keys, slice_of, hot)
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    per_slice = (
        rows.filter(HOT)
        .groupBy(*keys, SLICE)
        .agg(F.count(F.lit(1)).alias("_c"))
        .select(*keys, SLICE, F.sum("_c").over(before).alias("_c"))
    )
    in_slice = F.row_number().over(Window.partitionBy(*keys, SLICE).orderBy(*order)).cast("long")
    joined = null_safe_join(rows.withColumn("_seq", in_slice), per_slice, [*keys, SLICE])
    numbered = joined.withColumn("_seq", F.col("_seq") + F.coalesce(F.col("_c"), F.lit(0)))
    zero_based = F.col("_seq") - 1
    home = numbered.withColumn(
        "_block", F.when(F.col(HOT), F.floor(zero_based / block_rows)).otherwise(F.lit(0)).cast("long")
    )
    blocks = F.when(
        F.col(HOT) & (F.pmod(zero_based, F.lit(block_rows)) >= F.lit(block_rows - (size - 1))),
        F.array(F.col("_block"), F.col("_block") + 1),
    ).otherwise(F.array(F.col("_block")))
    spread = home.withColumn("_at", F.explode(blocks))
    built = build(Window.partitionBy(*keys, "_at").orderBy("_seq"), F.col("_seq"))
    framed = spread.select("*", *[c.alias(n) for n, c in built.items()])
    return framed.filter(F.col("_at") == F.col("_block")).select(*df.columns, *built)


def trailing_sums(
    df: DataFrame,
    key,
    micros: Column,
    row_id: str,
    spans: dict[str, tuple[int, int]],
    measures: dict[str, Column],
    hot_rows=HOT_ROWS,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Sums over a time range behind each row.

    ``spans`` maps a label to (oldest, newest) offsets in microseconds, both inclusive and zero or negative; the
    result columns are named ``{measure}_{label}``.  Ordinary keys use Spark's range frame.  That frame adds all its rows
    again for every row, so for keys that are hot, or dense over the longest range, ranges are put together from slices of
    time no longer than the range: the end of the oldest slice, the whole slices between, and the beginning of the newest
    one.  The first and the last come from ordered passes over one slice, in which the times of the rows ask at the two ends
    of their range.  Rows of one key and time share their sums, so ids may repeat; rows without a time share a frame.
    """
    keys = _names(key)
    names = [f"{m}_{s}" for s in spans for m in measures]
    timed = df.withColumn("_us", micros)

    def framed(rows: DataFrame) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy("_us")
        return rows.select(
            *df.columns,
            *[
                F.coalesce(F.sum(c).over(window.rangeBetween(lo, hi)), F.lit(0)).alias(f"{m}_{s}")
                for s, (lo, hi) in spans.items()
                for m, c in measures.items()
            ],
        )

    longest = max((hi - lo for lo, hi in spans.values()), default=0)
    listed = (
        hot_rows.dense(df, keys, micros, longest) if isinstance(hot_rows, HotKeys) else list_dense_keys(df, keys, micros, longest, hot_rows)
    )
    if listed is None:
        return framed(timed)
    marked = _mark(timed, keys, listed)
    sliced = F.col(HOT) & F.col("_us").isNotNull()
    hot = marked.filter(sliced).drop(HOT)
    times = hot.groupBy(*keys, "_us").agg(*[F.sum(c).alias(f"_m_{m}") for m, c in measures.items()])
    warm = hot
    for label, (lo, hi) in spans.items():
        length = max(1, min(max(slice_seconds * 1_000_000, (hi - lo) // RANGE_SLICES), hi - lo))
        parts = _sums_by_slices(times, keys, lo, hi, length, list(measures)).withColumnsRenamed({m: f"{m}_{label}" for m in measures})
        warm = null_safe_join(warm, parts, [*keys, "_us"])
    return framed(marked.filter(~sliced)).unionByName(warm.select(*df.columns, *names)).select(*df.columns, *names)


def _sums_by_slices(times: DataFrame, keys: list[str], lo: int, hi: int, length: int, measures: list[str]) -> DataFrame:
    """(keys, _us, measures): sums over [_us + lo, _us + hi] for every time of a key, from slices of ``length`` microseconds.

    ``times`` has one row per key and time with the sums ``_m_`` of its rows.
    """
    slice_of = lambda at: F.floor(at / F.lit(length)).cast("long")
    points = times.withColumn("_ask", F.explode(F.array(F.lit("row"), F.lit("old"), F.lit("new"))))
    own = F.col("_ask") == "row"
    at = F.col("_us") + F.when(F.col("_ask") == "old", F.lit(lo)).when(F.col("_ask") == "new", F.lit(hi)).otherwise(F.lit(0))
    points = points.select(
        *keys, "_us", "_ask", at.alias("_at"), slice_of(at).alias(SLICE), *[F.when(own, F.col(f"_m_{m}")).alias(f"_m_{m}") for m in measures]
    )
    # both are running sums, from either end: a frame that ends with the slice would be added again for every row
    inner = Window.partitionBy(*keys, SLICE)
    up_to, on_from = (inner.orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("_at"), F.desc("_at")))
    one = hi - lo < length  # such a range may lie in one slice; slices of one microsecond then hold it whole
    edges = points.select(
        *keys, "_us", "_ask", SLICE, *[F.sum(f"_m_{m}").over(up_to).alias(f"_u_{m}") for m in measures],
        *[F.sum(f"_m_{m}").over(on_from).alias(f"_o_{m}") for m in measures],
    ).filter(~own)
    whole = (hi - lo) // length  # slices between the two ends: one less than this, or this many
    outer = Window.partitionBy(*keys).orderBy(SLICE)
    between = {k: outer.rangeBetween(-k, -1) for k in (whole - 1, whole) if k > 0}
    per_slice = points.groupBy(*keys, SLICE).agg(*[F.sum(f"_m_{m}").alias(f"_c_{m}") for m in measures]).select(
        *keys, SLICE, *[F.sum(f"_c_{m}").over(w).alias(f"_w{k}_{m}") for k, w in between.items() for m in measures]
    )
    joined = null_safe_join(edges, per_slice, [*keys, SLICE])
    count = slice_of(F.col("_us") + hi) - slice_of(F.col("_us") + lo) - 1
    newest = F.col("_ask") == "new"

    def middle(m: str) -> Column:
        found = F.lit(None)
        for k in between:
            found = F.when(newest & (count == k), F.col(f"_w{k}_{m}")).otherwise(found)
        return found

    same = F.lit(one) & ~newest & (count == -1)  # counted by the other end already
    parts = [
        F.when(~same, F.coalesce(F.when(newest, F.col(f"_u_{m}")).otherwise(F.col(f"_o_{m}")), F.lit(0)) + F.coalesce(middle(m), F.lit(0))).alias(m)
        for m in measures
    ]
    return joined.select(*keys, "_us", *parts).groupBy(*keys, "_us").agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures])


def distinct_trailing(
    df: DataFrame, key, item: str, micros: Column, row_id: str, span: int, name: str, hot_rows=HOT_ROWS,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Distinct ``item`` values per key in (t - span, t].

    An item is present from each sighting until its next one or ``span`` later, whichever is first.  Those intervals
    never overlap for one item, so the distinct count is a running sum of +1 at starts and -1 at ends.
    """
    keys = _names(key)
    hot = hot_rows if isinstance(hot_rows, HotKeys) else HotKeys(df, keys, hot_rows=hot_rows)
    seen = neighbours(
        df.withColumn("_us", micros), [*keys, item], ["_us", row_id], time_slice(F.col("_us"), slice_seconds),
        following={"_next": F.col("_us")}, hot_rows=hot,
    )
    end = F.least(F.coalesce(F.col("_next"), F.col("_us") + span), F.col("_us") + span)
    payload = F.struct(*[F.col(c) for c in df.columns])
    unit = F.when(F.col(item).isNotNull(), F.lit(1)).otherwise(F.lit(0))
    nothing = F.lit(None).cast(df.select(payload.alias("p")).schema["p"].dataType)
    steps = seen.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("_us").alias("_at"), unit.alias("_d"), payload.alias("_row")),
                F.struct(end.alias("_at"), (-unit).alias("_d"), nothing.alias("_row")),
            )
        ),
    )
    counted = running_sums(
        steps, keys, F.col("_at"), {name: F.col("_d")}, time_slice(F.col("_at"), slice_seconds), hot
    )
    return counted.filter(F.col("_row").isNotNull()).select(
        *[F.col(f"_row.{c}").alias(c) for c in df.columns], F.col(name).cast("long").alias(name)
    )


def top_rows(
    df: DataFrame, key, order: Sequence[Column], n: int, salt: Column, salts: int = 64, rank: str | None = None
) -> DataFrame:
    """First ``n`` rows per key: first within each salted part, then among the survivors."""
    keys = _names(key)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    kept = salted.withColumn("_rn", F.row_number().over(part)).filter(F.col("_rn") <= n).drop("_rn", "_salt")
    ranked = kept.withColumn("_rn", F.row_number().over(whole)).filter(F.col("_rn") <= n)
    return ranked.withColumnRenamed("_rn", rank) if rank else ranked.drop("_rn")


#: Distinct values of one slice, roughly, and the most slices.
SLICE_VALUES, MOST_SLICES = 500_000, 1024


def even_slices(counts: DataFrame, value: str, slice_values: int = SLICE_VALUES) -> Column:
    """A slice number that grows with ``value``, from bounds between which ``counts`` has like numbers of rows.

    The bounds come from a sketch of the values (combined map-side), so slices are even wherever the values lie; a value
    that many rows share is one row of ``counts``. Nulls come before all slices, what is no number in the last.
    """
    number = F.col(value).cast("double")
    shares = [i / MOST_SLICES for i in range(1, MOST_SLICES)]
    n, sketch = counts.agg(F.count(value), F.percentile_approx(number, shares, 20 * MOST_SLICES)).first()
    wanted = min(MOST_SLICES, max(1, -(-(n or 0) // slice_values), 8 if n and n > 64 else 1))
    step = MOST_SLICES // wanted
    bounds = sorted({x for x in (sketch or [])[step - 1:: step] if math.isfinite(x)})

    def tree(lo: int, hi: int) -> str:
        mid = (lo + hi) // 2
        return str(lo) if lo == hi else f"if(_v <= {bounds[mid]!r}D, {tree(lo, mid)}, {tree(mid + 1, hi)})"

    found = F.expr(tree(0, len(bounds)).replace("_v", f"cast(`{value}` AS double)"))
    return F.when(number.isNull(), -1).otherwise(found).cast("long")


def exact_quantiles(
    df: DataFrame, group, value: str, quantiles: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Exact linear-interpolation quantiles per group without holding a group in one task.

    Values are counted first (combined map-side) and written, ranks come from running sums of the counts over even slices of
    the values, and only the rows that cover a wanted rank reach the final group-by.
    """
    keys = _names(group)
    size = F.sum(weight) if weight else F.count(F.lit(1))
    counts = written(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(size.alias("_n")), "value-counts")
    counts = counts.withColumn(SLICE, even_slices(counts, value))
    inner = Window.partitionBy(*keys, SLICE).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    all_rows = Window.partitionBy(*keys)
    per_slice = counts.groupBy(*keys, SLICE).agg(F.sum("_n").alias("_c")).select(
        *keys, SLICE,
        F.coalesce(F.sum("_c").over(all_rows.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"),
        F.sum("_c").over(all_rows).alias("_t"),
    )
    ranked = null_safe_join(counts.withColumn("_cum", F.sum("_n").over(inner)), per_slice, [*keys, SLICE], "inner")
    last = F.col("_b") + F.col("_cum") - 1
    first = last - F.col("_n") + 1
    aggs, out, wanted = [], [], F.lit(False)
    for name, q in quantiles.items():
        at = F.lit(q) * (F.col("_t") - 1)
        lo, hi = F.floor(at), F.ceil(at)
        covers_lo, covers_hi = (first <= lo) & (lo <= last), (first <= hi) & (hi <= last)
        wanted = wanted | covers_lo | covers_hi
        aggs += [
            F.max(F.when(covers_lo, F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when(covers_hi, F.col(value))).alias(f"_hi_{name}"),
            F.max(at - lo).alias(f"_f_{name}"),
        ]
        out.append(
            (F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_f_{name}"))
            .cast("double").alias(name)
        )
    return ranked.filter(wanted).groupBy(*keys).agg(*aggs).select(*keys, *out)
