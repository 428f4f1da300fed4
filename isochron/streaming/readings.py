"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from isochron.functions.timeaxis import ROWS_PER_DAY, SITE_ZONE, site_ts
from isochron.functions.units import exact_mean


def _instant(ts: str) -> Column:
    """A watermark needs an instant; naive UTC is one in a session whose zone is UTC."""
    return F.col(ts).cast("timestamp")


def complete_days(readings: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", late: str = "2 days") -> DataFrame:
    """Totals of UTC hours, to be kept and made into complete site days by a batch (``days_of_hours``); ``site_days`` gives the days from the stream itself."""
    timed = readings.withColumn("__t", _instant(ts)).withWatermark("__t", late)
    hours = timed.groupBy(*keys, F.window("__t", "1 hour").alias("w")).agg(F.sum(value).alias("total"), F.count(value).alias("readings"))
    return hours.select(*keys, F.col("w.start").cast("timestamp_ntz").alias("hour"), "total", "readings")


def days_of_hours(hours: DataFrame, keys: list[str], rows: int = ROWS_PER_DAY, zone: str = SITE_ZONE) -> DataFrame:
    """Complete site days from the hours that ``complete_days`` wrote."""
    from isochron.functions.timeaxis import site_day

    days = hours.groupBy(*keys, site_day("hour", zone).alias("d")).agg(F.sum("total").alias("total"), F.sum("readings").alias("readings"))
    return days.where(F.col("readings") == rows)


def site_days(readings: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", per_hour: int = 1, late: str = "2 days", zone: str = SITE_ZONE) -> DataFrame:
    """Site days from one stream in append mode: keys, d, total, readings, hours, hours_of_day, complete.

    Two aggregations in a row: readings to hours, hours with at least ``per_hour`` readings to days. Event time is the site's wall clock, so a
    window of 24 hours of it is a site day, also where the clock changes: the spring day has 23
    hours, and the autumn day 25, as an hour is told by its UTC time as well. complete: all of the day's hours have enough
    readings. A day comes out once, when the watermark has passed its end; ``late`` must exceed the hour
    by which the clock goes back. Values that are null count as readings missing.
    """
    clock = readings.withColumn("__clock", site_ts(ts, zone).cast("timestamp")).withColumn("__utc", F.date_trunc("hour", F.col(ts)))
    timed = clock.withWatermark("__clock", late)
    hours = timed.groupBy(*keys, F.window("__clock", "1 hour").alias("w"), "__utc").agg(F.sum(value).alias("__total"), F.count(value).alias("__n"))
    enough = F.count_if(F.col("__n") >= per_hour)
    days = hours.groupBy(*keys, F.window("w", "1 day").alias("day")).agg(F.sum("__total").alias("total"), F.sum("__n").alias("readings"), enough.alias("hours"))
    midnight = lambda d: F.convert_timezone(F.lit(zone), F.lit("UTC"), d.cast("timestamp_ntz"))
    d = F.to_date("day.start")
    of_day = F.expr("timestampdiff(HOUR, __from, __to)").cast("int")
    out = days.withColumn("__from", midnight(d)).withColumn("__to", midnight(F.date_add(d, 1))).withColumn("hours_of_day", of_day)
    return out.select(*keys, d.alias("d"), "total", "readings", "hours", "hours_of_day", (F.col("hours") == F.col("hours_of_day")).alias("complete"))


def sliding(readings: DataFrame, keys: list[str], length: str = "2 hours", step: str = "30 minutes", ts: str = "ts", value: str = "value", late: str = "1 hour") -> DataFrame:
    """Means over sliding windows, from exact sums: the same for any order of arrival."""
    timed = readings.withColumn("__t", _instant(ts)).withWatermark("__t", late)
    out = timed.groupBy(*keys, F.window("__t", length, step).alias("w")).agg(exact_mean(value).alias("mean"), F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mean", "n")


def sessions(readings: DataFrame, keys: list[str], gap: str = "30 minutes", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Sessions: readings with no more than ``gap`` between them."""
    timed = readings.withColumn("__t", _instant(ts)).withWatermark("__t", late)
    out = timed.groupBy(*keys, F.session_window("__t", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_only(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events without repeats of the same keys within the watermark."""
    return events.withColumn("__t", _instant(ts)).withWatermark("__t", late).dropDuplicatesWithinWatermark(keys).drop("__t")


def running_store(steps: DataFrame, key: str, initial: float, residual: float, capacity: float) -> DataFrame:
    """The capped bucket over a stream of (key, ts, rain, et0) that comes in order: key, ts, store, outflow. Rows are folded as they arrive; ``store_in_order`` waits for late ones."""

    def advance(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        store = state.get[0] if state.exists else None
        rows = pd.concat(batches).sort_values("ts")
        out = []
        for r in rows.itertuples():
            if store is None:
                level = initial
            else:
                level = store + r.rain - r.et0 * min(max((store - residual) / (capacity - residual), 0.0), 1.0)
            store = min(level, capacity)
            out.append((k[0], r.ts, store, max(level - capacity, 0.0)))
        if store is not None:
            state.update((store,))
        yield pd.DataFrame(out, columns=[key, "ts", "store", "outflow"])

    kind = steps.schema[key].dataType.simpleString()
    return steps.groupBy(key).applyInPandasWithState(advance, f"{key} {kind}, ts timestamp, store double, outflow double", "store double", "append", "NoTimeout")


class _InOrder(StatefulProcessor):
    """Per group of keys: the stores and the numbers of steps folded into them, and the steps that the watermark has not passed."""

    def __init__(self, kind: str, initial: float, residual: float, capacity: float) -> None:
        self.kind, self.initial, self.residual, self.capacity = kind, initial, residual, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getListState("folded", f"key {self.kind}, store double, steps bigint")
        self.pending = handle.getListState("pending", f"key {self.kind}, at bigint, rain double, et0 double")
        self.woken = set()  # groups folded in this batch: a later timer finds nothing due

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the API calls by these names
        if key[0] is not None:
            came = [x for f in rows for x in zip(*(f[c].tolist() for c in ("key", "at", "rain", "et0")), strict=True)]
            self.pending.appendList(came)
            self.handle.registerTimer(min(x[1] for x in came) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if key[0] in self.woken:
            return
        self.woken.add(key[0])
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        steps = sorted(tuple(x) for x in self.pending.get()) if self.pending.exists() else []
        stores = {k: (store, n) for k, store, n in self.folded.get()} if self.folded.exists() else {}
        out, rest = [], []
        for step in steps:
            k, at, rain, et0 = step
            if at > passed:
                rest.append(step)
                continue
            store, n = stores.get(k, (None, 0))
            if store is None:
                level, loss = self.initial, None
            else:
                loss = et0 * min(max((store - self.residual) / (self.capacity - self.residual), 0.0), 1.0)
                level = store + rain - loss
            store = min(level, self.capacity)
            out.append((k, at, n, store, max(level - self.capacity, 0.0), loss))
            stores[k] = store, n + 1
        if out:
            self.folded.put([(k, *x) for k, x in stores.items()])
            if rest:
                self.pending.put(rest)
            else:
                self.pending.clear()
        if rest:
            self.handle.registerTimer(min(x[1] for x in rest) // 1000)
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "step", "store", "outflow", "loss"])

    def close(self) -> None:
        pass


def store_in_order(steps: DataFrame, key: str, initial: float, residual: float, capacity: float, late: str = "2 days", ts: str = "ts", groups: int = 1024) -> DataFrame:
    """The capped bucket over a stream of (key, ts, rain, et0) whose rows come late: key, ts, step (from 0), store, outflow, loss.

    Steps wait, sorted, until the watermark has passed them, and are folded in the order of their time; so batches in any order, and
    any cut into batches, give the fold of the whole record, as no row is later than ``late``. Later ones
    are dropped, and Spark counts them. Keys are dealt to ``groups`` by hash, as each call of a state costs milliseconds, however few rows it has; a group is read whole
    by a task. A timer per group wakes it at the time of its earliest waiting step. State per key: its store and the steps of
    ``late``, in RocksDB (see ``streaming.replay.state_on_disk``), so a restart goes on from there. Rows without a key only
    move the clock. Steps of a key at one time are folded in order of rain, then et0. The first step starts at
    ``initial``; its loss is null.
    """
    timed = steps.withColumn("__t", _instant(ts)).withWatermark("__t", late)
    group = F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(groups)).cast("int"))
    rows = timed.select(group.alias("group"), F.col(key).alias("key"), "__t", F.unix_micros("__t").alias("at"), F.col("rain").cast("double"), F.col("et0").cast("double"))
    kind = steps.schema[key].dataType.simpleString()
    out = rows.groupBy("group").transformWithStateInPandas(
        _InOrder(kind, initial, residual, capacity), f"key {kind}, at bigint, step bigint, store double, outflow double, loss double", "append", "EventTime"
    )
    return out.select(F.col("key").alias(key), F.timestamp_micros("at").alias(ts), "step", "store", "outflow", "loss")
