"""State of the streaming detectors: lists and maps per key in RocksDB, dropped by event-time timers.

Results go out as soon as an event arrives. An event that arrives late, but within the watermark, changes the results of
events after it that went out already; with ``corrections`` those go out once more under a higher revision, so that the last
revision of every event is the same for any cut of the stream into batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ledgerwatch.functions.columns import micros

HOUR_US = 3_600_000_000
#: A time bucket is this many windows long: each one costs a few calls to the state, and one row in so many is a guest.
SPANS = 16
#: Keys of a time bucket share the state of so many groups: the calls to it don't grow with the keys.
GROUPS = 256
#: Rows whose windows are laid side by side at once.
BLOCK = 4096


def milliseconds(text: str) -> int:
    number, unit = text.split()
    return int(float(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1000)


def latest(results: DataFrame, row_id: str = "transaction_id") -> DataFrame:
    """The last revision of every event, without the revision."""
    values = [c for c in results.columns if c not in (row_id, "revision")]
    last = results.groupBy(row_id).agg(F.max_by(F.struct(*values), "revision").alias("_last"))
    return last.select(*[F.col(row_id) if c == row_id else F.col(f"_last.{c}").alias(c) for c in results.columns if c != "revision"])


def _gathered(rows: Iterator, names: list[str]) -> dict[str, np.ndarray]:
    """The columns of all frames of a key; identifiers stay objects."""
    frames = [{c: f[c].to_numpy() for c in names} for f in rows]
    return {c: np.concatenate([f[c] for f in frames]) for c in names}


# ---- trailing windows -----------------------------------------------------------------------

def bucketed(events: DataFrame, span_us: int, length_us: int) -> DataFrame:
    """Events under the time bucket they lie in and, as guests, under the next one if its windows reach back to them.

    With the bucket in the key of the state, a key with very many events is spread over as many tasks as it has buckets,
    every window still finds its rows in one place, and a bucket's state can go when the watermark has passed its end.
    """
    at = F.expr(f"us div {length_us} - IF(us < 0 AND us % {length_us} <> 0, 1, 0)")
    here = F.struct(F.col("_at").alias("bucket"), F.lit(False).alias("guest"))
    after = F.struct((F.col("_at") + 1).alias("bucket"), F.lit(True).alias("guest"))
    near = F.col("us") >= (F.col("_at") + 1) * length_us - span_us
    places = F.explode(F.when(near, F.array(here, after)).otherwise(F.array(here)))
    return events.withColumn("_at", at).withColumn("_place", places).select("*", "_place.*").drop("_at", "_place")


class Trailing(StatefulProcessor):
    """Rows of a group of keys in a time bucket; ``measure`` gives the results of those whose windows have new rows.

    The state is a list with one element of arrays per batch: a batch appends and rewrites nothing. ``measure`` takes the
    columns in order of key, time and id, and the places of the rows asked for, and returns output columns and a mask of the
    rows to emit; ``first`` says where each row's window begins, from times that leave more than ``span_us`` between keys.
    """

    def __init__(self, columns: dict[str, str], length_us: int, span_us: int, first: Callable, measure: Callable, corrections: bool):
        self.columns, self.length_us, self.span_us = {"owner": "string", **columns}, length_us, span_us
        self.first, self.measure, self.corrections = first, measure, corrections

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", ", ".join(f"{c} array<{kind}>" for c, kind in {**self.columns, "guest": "boolean"}.items()))

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        names = [*self.columns, "guest"]
        now = _gathered(rows, names)
        past = [dict(zip(names, e)) for e in self.kept.get()]
        if not past:
            self.handle.registerTimer(-(-(int(key[1]) + 1) * self.length_us // 1000))
        self.kept.appendValue(tuple(now[c].tolist() for c in names))
        kinds = {"us": "int64", "amount": "float64", "guest": bool}
        all_of = {c: np.concatenate([*(np.array(p[c], dtype=kinds.get(c, object)) for p in past), now[c].astype(kinds.get(c, object))]) for c in names}
        count = len(all_of["us"])
        new = np.arange(count) >= count - len(now["us"])
        owners, owner = np.unique(all_of["owner"].astype(str), return_inverse=True)
        order = np.lexsort((all_of["transaction_id"].astype(str), all_of["us"], owner))
        data, new, owner = {c: v[order] for c, v in all_of.items()}, new[order], owner[order]
        since = data["us"] - data["us"].min()
        first = self.first(since + owner * (since.max() + self.span_us + 2))
        data["begins"] = np.searchsorted(owner, owner, "left")
        arrived = np.concatenate([[0], np.cumsum(new)])
        touched = arrived[1:] - arrived[first] > 0
        wanted = np.flatnonzero((touched if self.corrections else new) & ~data["guest"])
        found, hit = self.measure(data, first, wanted)
        if hit.any():
            users = pd.array([int(o) if o else None for o in owners], dtype="Int64")
            out = pd.DataFrame({"user_id": users.take(owner[wanted][hit]), **{c: v[hit] for c, v in found.items()}})
            if self.corrections:
                out["revision"] = count
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.kept.clear()
        return iter([])


def velocity(rows: int, min_count: int) -> Callable:
    """Count, amount and distinct merchants of windows of at most ``rows`` rows, laid side by side as a matrix."""

    def measure(data: dict, first: np.ndarray, wanted: np.ndarray):
        counts = wanted + 1 - first[wanted]
        hit = counts >= min_count
        codes = np.unique(data["merchant"].astype(str), return_inverse=True)[1]
        by_code = np.lexsort((np.arange(len(codes)), codes))
        before = np.full(len(codes), -1)
        same = codes[by_code][1:] == codes[by_code][:-1]
        before[by_code[1:][same]] = by_code[:-1][same]
        amounts, merchants = np.zeros(len(wanted)), np.zeros(len(wanted), "int64")
        at = np.flatnonzero(hit)
        for block in (at[k : k + BLOCK] for k in range(0, len(at), BLOCK)):
            i = wanted[block]
            place = i[:, None] - np.arange(rows - 1, -1, -1)
            inside = place >= first[i][:, None]
            place = np.maximum(place, 0)
            amounts[block] = np.where(inside, data["amount"][place], 0.0).sum(axis=1)
            merchants[block] = (inside & (before[place] < first[i][:, None])).sum(axis=1)
        found = {"transaction_id": data["transaction_id"][wanted], "transaction_count": counts, "total_amount": amounts, "unique_merchants": merchants}
        return found, hit

    return measure


def running(data: dict, first: np.ndarray, wanted: np.ndarray):
    """Count and amount of each window, from running sums of each key."""
    starts = np.unique(data["begins"])
    upto = np.concatenate([np.cumsum(part) for part in np.split(data["amount"], starts[1:])])
    before = np.concatenate([[0.0], upto[:-1]])
    before[starts] = 0.0
    found = {c: data[c][wanted] for c in ("transaction_id", "merchant_id", "amount")}
    found["ts"] = data["us"][wanted].astype("datetime64[us]")
    return {**found, "recent_count": wanted + 1 - first[wanted], "recent_amount": upto[wanted] - before[first[wanted]]}, np.ones(len(wanted), bool)


def trailing(events: DataFrame, key: str, watermark: str, span_us: int, length_us: int, processor: Trailing, schema: str, **columns: Column) -> DataFrame:
    """Run a processor of trailing windows over a stream; events without a time have no window and are left out."""
    owner, group = F.coalesce(F.col(key).cast("string"), F.lit("")).alias("owner"), F.pmod(F.xxhash64(key), F.lit(GROUPS)).alias("group")
    keyed = events.withWatermark("ts", watermark).where("ts IS NOT NULL").select(group, owner, "ts", micros("ts").alias("us"), *[c.alias(n) for n, c in columns.items()])
    revision = ", revision long" if processor.corrections else ""
    grouped = bucketed(keyed, span_us, length_us).groupBy("group", "bucket")
    return grouped.transformWithStateInPandas(processor, schema + revision, "append", "EventTime")


# ---- hours of a merchant --------------------------------------------------------------------

class HourlyBaseline(StatefulProcessor):
    """Events of open hours and sums of closed ones, by hour; an event is compared with the hours before its own.

    An hour is open until the watermark passes its end. Of the closed ones the last ``buckets`` are kept, which tells
    whether an hour has more than that many before it. After ``idle_hours`` without an event a merchant begins anew, by the
    same rule whether its state has been dropped by then or not.
    """

    def __init__(self, count_factor: float, amount_factor: float, buckets: int, idle_hours: int, corrections: bool):
        self.count_factor, self.amount_factor, self.buckets = count_factor, amount_factor, buckets
        self.idle_hours, self.corrections = idle_hours, corrections

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "hour long", "us array<long>, amount array<double>, id array<string>")
        self.closed = handle.getMapState("closed", "hour long", "n long, amount double")
        self.arrived = handle.getValueState("arrived", "n long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        now = _gathered(rows, ["us", "amount", "transaction_id"])
        arrived = len(now["us"]) + (self.arrived.get()[0] if self.arrived.exists() else 0)
        self.arrived.update((arrived,))
        at = now["us"].astype("int64") // HOUR_US
        order = np.argsort(at, kind="stable")
        fresh, starts = np.unique(at[order], return_index=True)
        parts = dict(zip(fresh.tolist(), np.split(order, starts[1:])))
        hours = self._held()
        if not hours or max(parts) > max(hours):
            end = (max(parts) + 1) * HOUR_US // 1000
            self.handle.registerTimer(end)
            self.handle.registerTimer(end + self.idle_hours * 3_600_000)
        for hour, part in parts.items():
            mine = (now["us"][part].astype("int64"), now["amount"][part].astype("float64"), now["transaction_id"][part], np.ones(len(part), bool))
            if hour in hours:
                mine = tuple(np.concatenate(c) for c in zip(hours[hour], mine))
            by_time = np.lexsort((mine[2].astype(str), mine[0]))
            hours[hour] = tuple(c[by_time] for c in mine)
        out = self._compared(hours, int(now["us"].min()), min(parts))
        self._store(timerValues.getCurrentWatermarkInMs(), hours, set(parts))
        if out:
            found = pd.DataFrame({c: np.concatenate([o[c] for o in out]) for c in out[0]})
            found.insert(1, "merchant_id", pd.array([key[0]] * len(found), dtype="Int64"))
            if self.corrections:
                found["revision"] = arrived
            if len(found):
                yield found

    def _compared(self, hours: dict[int, tuple], earliest_us: int, earliest: int) -> list[dict]:
        sums = {h: (n, a) for (h,), (n, a) in self.closed.iterator()}
        running = {h: np.cumsum(v[1]) for h, v in hours.items()}
        sums.update({h: (len(v[0]), float(running[h][-1])) for h, v in hours.items()})
        order = np.array(sorted(sums), "int64")
        counts, amounts = (np.array([sums[h][k] for h in order.tolist()], "float64") for k in (0, 1))
        begins = np.concatenate([[True], np.diff(order) - 1 >= self.idle_hours])
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))
        width, out = self.buckets - 1, []
        for k in np.flatnonzero((rank >= self.buckets) & (order >= earliest)).tolist():
            hour = int(order[k])
            us, _, ids, new = hours[hour]
            peers = np.searchsorted(us, us, "right")
            c, a = peers, running[hour][peers - 1]
            usual_n = (counts[k - width : k].sum() + c) / self.buckets
            usual_a = (amounts[k - width : k].sum() + a) / self.buckets
            odd = (c > usual_n * self.count_factor) | (a > usual_a * self.amount_factor)
            # an event that went out before may have been called odd then: both answers go out again
            pick = ((new & odd) | (~new & (us >= earliest_us))) if self.corrections else new & odd
            found = {
                "transaction_id": ids[pick], "current_count": c[pick], "baseline_count": usual_n[pick],
                "current_amount": a[pick], "baseline_amount": usual_a[pick],
            }
            out.append({**found, "alert": odd[pick]} if self.corrections else found)
        return out

    def _held(self) -> dict[int, tuple]:
        """The open hours: times, amounts, ids, and that none of them is new."""
        return {
            hour: (np.array(us, "int64"), np.array(amount, "float64"), np.array(ids, object), np.zeros(len(us), bool))
            for (hour,), (us, amount, ids) in self.open.iterator()
        }

    def _store(self, watermark_ms: int, hours: dict[int, tuple], changed: set[int]) -> None:
        """Write the changed hours; those that no event can reach any more become sums, of which the last ones are kept."""
        past = sorted(h for h in hours if (h + 1) * HOUR_US // 1000 <= watermark_ms)
        rest = [h for h in hours if (h + 1) * HOUR_US // 1000 > watermark_ms]
        if len(past) > len(rest):  # cheaper to begin anew
            self.open.clear()
            changed = set(rest)
        else:
            for hour in past:
                self.open.removeKey((hour,))
        for hour in rest:
            if hour in changed:
                self.open.updateValue((hour,), tuple(c.tolist() for c in hours[hour][:3]))
        for hour in past[-self.buckets :]:
            self.closed.updateValue((hour,), (len(hours[hour][0]), float(np.cumsum(hours[hour][1])[-1])))
        if past:
            for hour in sorted(h for (h,) in self.closed.keys())[: -self.buckets]:
                self.closed.removeKey((hour,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        watermark, hours = timerValues.getCurrentWatermarkInMs(), self._held()
        last = max([*hours, *(h for (h,) in self.closed.keys())], default=None)
        if last is not None and (last + 1 + self.idle_hours) * HOUR_US // 1000 <= watermark:
            for state in (self.open, self.closed, self.arrived):
                state.clear()
        else:
            self._store(watermark, hours, set())
        return iter([])
