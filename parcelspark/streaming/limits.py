"""Stateful limits and incremental ingestion with Structured Streaming."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ADMITTED = "user_id long, event_id long, ts timestamp, admitted boolean"


def _admit(times: list[float], held: list[float], most: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Admissions in order: a denied hit is not recorded, so it never counts against later ones."""
    out = []
    for t in times:
        held = [h for h in held if h > t - seconds]
        ok = len(held) < most
        out.append(ok)
        if ok:
            held.append(t)
    return out, held


def admissions(events: DataFrame, most: int = 10, seconds: float = 60.0) -> DataFrame:
    """Sliding-window admissions per user, in batch (V1): an ordered fold, as each depends on earlier ones.

    A user's events are cut at gaps of ``seconds`` or more, over which nothing is
    held; the cuts come from the first and last time of each user's slots of that
    width.  A segment's rows stream past in order, with at most ``most`` times
    held, however many there are.  A null time is in no window.
    """
    micros = round(seconds * 1_000_000)
    rows = events.select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.withColumn("at", F.unix_micros("ts")).withColumn("slot", F.floor(F.col("at") / F.lit(max(micros, 1))))
    order = Window.partitionBy("user_id").orderBy("slot")
    slots = rows.groupBy("user_id", "slot").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    cuts = F.coalesce((F.col("first") - F.lag("last").over(order) >= micros).cast("long"), F.lit(1))
    slots = slots.withColumn("cut", cuts).select(F.col("user_id").alias("u"), F.col("slot").alias("s"), F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("segment"))
    joined = rows.join(slots, F.col("user_id").eqNullSafe(F.col("u")) & F.col("slot").eqNullSafe(F.col("s")))
    key = ["user_id", "segment"]
    dealt = joined.select(*key, "event_id", "ts", "at").repartition(*key).sortWithinPartitions(*key, F.asc_nulls_last("at"), F.asc_nulls_last("event_id"))

    def fold(batches):
        import pyarrow as pa

        of, held = None, deque()
        for batch in batches:
            out = []
            for k in zip(*(batch.column(c).to_pylist() for c in (*key, "at"))):
                if k[:2] != of:
                    of, held = k[:2], deque()
                at = k[2]
                while held and at is not None and held[0] <= at - micros:
                    held.popleft()
                ok = len(held) < most
                out.append(ok)
                if ok and at is not None:
                    held.append(at)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("user_id", "event_id", "ts")), pa.array(out, pa.bool_())], names=["user_id", "event_id", "ts", "admitted"])

    return dealt.mapInArrow(fold, ADMITTED)


def admissions_stream(events: DataFrame, most: int = 10, seconds: float = 60.0) -> DataFrame:
    """The same of a stream; the state of a user is the admitted times still in the window."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        ok, held = _admit([t.timestamp() for t in rows["ts"]], held, most, seconds)
        state.update((held,))
        yield rows.assign(admitted=ok)[["user_id", "event_id", "ts", "admitted"]]

    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return rows.groupBy("user_id").applyInPandasWithState(step, ADMITTED, "held array<double>", "append", GroupStateTimeout.NoTimeout)


def fixed_window_counts(events: DataFrame, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Hits per user and fixed window, batch or stream (V2); epoch-aligned windows."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy("user_id", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("hits")).select("user_id", F.col("w.start").alias("begins"), "hits")


def monthly_quota(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Running monthly counts per user of a stream or a batch (V4)."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy("user_id", F.date_trunc("month", "ts").alias("month")).agg(F.count("*").alias("events"))


def distinct_uploads(uploads: DataFrame, late: str = "1 day") -> DataFrame:
    """Uploads without repeats of their content hash (V9)."""
    if uploads.isStreaming:
        return uploads.withWatermark("ts", late).dropDuplicatesWithinWatermark(["content_hash"])
    return uploads.dropDuplicates(["content_hash"])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Session windows per user; an addition of ours, with late rows dropped by the watermark in streams."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("begins"), "events")


class _Thresholds(StatefulProcessor):
    """State of one account: what it has spent this month, and the levels it was told of; a timer ends the month."""

    def __init__(self, budget: float, levels: tuple[float, ...]):
        self.budget, self.levels = budget, sorted(levels)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = handle.getMapState("spent", "month string", "units long")
        self.told = handle.getMapState("told", "month string", "levels int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        out = []
        for month, group in events.sort_values(["ts", "event_id"]).groupby(events["ts"].dt.strftime("%Y-%m")):
            at = (month,)
            spent, told = self.spent.getValue(at)[0] if self.spent.containsKey(at) else 0, self.told.getValue(at)[0] if self.told.containsKey(at) else 0
            if spent == 0 and told == 0:  # forgotten once no late event of the month can come
                end = (pd.Timestamp(month + "-01") + pd.offsets.MonthBegin(1)).tz_localize("UTC")
                self.handle.registerTimer(int(end.timestamp() * 1000))
            for event_id, ts, units in zip(group["event_id"], group["ts"], group["units"]):
                spent += int(units)
                while told < len(self.levels) and spent >= self.levels[told] * self.budget:
                    out.append((key[0], month, self.levels[told], event_id, ts))
                    told += 1
            self.spent.updateValue(at, (spent,))
            self.told.updateValue(at, (told,))
        if out:
            yield pd.DataFrame(out, columns=["account", "month", "level", "event_id", "ts"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ended = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms") - pd.Timedelta(days=1)
        at = (ended.strftime("%Y-%m"),)
        for state in (self.spent, self.told):
            if state.containsKey(at):
                state.removeKey(at)
        yield from ()

    def close(self) -> None:
        pass


CROSSED = "account long, month string, level double, event_id long, ts timestamp"


def threshold_stream(events: DataFrame, budget: float, levels: tuple[float, ...] = (0.5, 0.8), late: str = "1 day") -> DataFrame:
    """Each account's first event of a month at which its units reach each share of ``budget`` (V5); each is told once.

    ``events``: account, event_id, ts, units (long).  What was told lives in the
    state store, so it survives restarts and lasts as long as the month; a timer at
    the month's end, by the watermark, lets it go.
    """
    rows = events.select(F.col("account").cast("long").alias("account"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.col("units").cast("long"), F.lit(0)).alias("units"))
    kept = rows.where("ts IS NOT NULL AND account IS NOT NULL").withWatermark("ts", late)
    return kept.groupBy("account").transformWithStateInPandas(_Thresholds(budget, levels), CROSSED, "append", "eventTime")


def thresholds(events: DataFrame, budget: float, levels: tuple[float, ...] = (0.5, 0.8)) -> DataFrame:
    """The same of a batch: units are added up per account, month and day first, then within the day of a crossing."""
    rows = events.where("ts IS NOT NULL AND account IS NOT NULL").select(F.col("account").cast("long").alias("account"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.col("units").cast("long"), F.lit(0)).alias("units"))
    rows = rows.withColumns({"month": F.date_format("ts", "yyyy-MM"), "day": F.to_date("ts")})
    days = rows.groupBy("account", "month", "day").agg(F.sum("units").alias("units"))
    before = F.coalesce(F.sum("units").over(Window.partitionBy("account", "month").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.withColumn("before", before).withColumn("level", F.explode(F.array(*map(F.lit, sorted(levels)))))
    days = days.where((F.col("before") < F.col("level") * budget) & (F.col("before") + F.col("units") >= F.col("level") * budget)).drop("units")
    within = Window.partitionBy("account", "month", "level").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    crossed = days.join(rows, ["account", "month", "day"]).withColumn("spent", F.col("before") + F.sum("units").over(within)).where(F.col("spent") >= F.col("level") * budget)
    first = crossed.groupBy("account", "month", "level").agg(F.min(F.struct("ts", "event_id")).alias("x"))
    return first.select("account", "month", "level", F.col("x.event_id").alias("event_id"), F.col("x.ts").alias("ts"))


class _Jobs(StatefulProcessor):
    """State of one job: where it stands and since when; a timer turns it stale."""

    def __init__(self, limits: dict[str, int]):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "state string, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "state"])
        state, at = self.state.get() if self.state.exists() else (None, -1)
        out = []
        for name, ts in zip(events["state"], events["ts"]):
            ms = int(ts.timestamp() * 1000)
            if (ms, name) > (at, state or ""):  # an event older than the job's last changes nothing
                state, at = name, ms
                out.append((key[0], name, ts))
        if out:
            self.state.update((state, at))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if state in self.limits:
                self.handle.registerTimer(at + self.limits[state] * 60_000 + 1)
            else:
                self.state.clear()  # a job that is done comes to nothing more
            yield pd.DataFrame(out, columns=["job_id", "state", "ts"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([(key[0], "stale", pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"))], columns=["job_id", "state", "ts"])

    def close(self) -> None:
        pass


CHANGED = "job_id long, state string, ts timestamp"


def job_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Changes of jobs as they come, and ``stale`` for one that is queued or processing for too long (V8).

    ``events``: job_id, state, ts.  The limit is that of the last state by event
    time, and passes by the watermark; what is done leaves no state behind.
    """
    from parcelspark.operators.scope import STALE_MINUTES

    rows = events.select(F.col("job_id").cast("long").alias("job_id"), "state", F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.where("ts IS NOT NULL AND state IS NOT NULL AND job_id IS NOT NULL").withWatermark("ts", late)
    return rows.groupBy("job_id").transformWithStateInPandas(_Jobs(STALE_MINUTES), CHANGED, "append", "eventTime")
