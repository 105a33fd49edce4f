"""Panels from event streams, and the scalar filter as a stateful streaming operator."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from geopanel.operators.work import shared


def stream_panel(events: DataFrame, site: str, ts: str, value: str, step: str = "1 day", late: str = "2 days") -> DataFrame:
    """(site, start, y, n): mean value of a site a step, closed once the watermark has passed the step."""
    w = events.withWatermark(ts, late).groupBy(F.col(site).alias("site"), F.window(ts, step).alias("w"))
    return w.agg(F.avg(value).alias("y"), F.count(value).alias("n")).select("site", F.col("w.start").alias("start"), "y", "n")


def stream_filter(panel: DataFrame, f: float, q: float, r: float, x0: float, p0: float, step_seconds: int = 86_400) -> DataFrame:
    """(site, start, x, p, loglik) for every closed step of a stream (site, start, y).

    panel is a stream of closed steps, such as a table that stream_panel writes: the stateful operator does not follow
    another aggregation in one query. The state of a site is four numbers. Steps that a site skips are predicted through; steps that arrive after a later
    one of the site was filtered are ignored.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        x, p, ll, last = state.get if state.exists else (x0, p0, 0.0, None)
        rows = pd.concat(list(frames)).sort_values("start")
        out = []
        for start, y in zip(rows["start"], rows["y"], strict=True):
            at = int(start.timestamp())
            if last is not None and at <= last:
                continue
            for _ in range(1 if last is None else (at - last) // step_seconds):
                x, p = f * x, f * f * p + q
            if y is not None and not math.isnan(y):
                s, e = p + r, y - x
                ll -= 0.5 * (math.log(2 * math.pi * s) + e * e / s)
                x, p = x + p / s * e, (1 - p / s) * p
            last = at
            out.append((key[0], start, x, p, ll))
        state.update((x, p, ll, last))
        yield pd.DataFrame(out, columns=["site", "start", "x", "p", "loglik"])

    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = dict(panel.dtypes)["site"]
    return panel.groupBy("site").applyInPandasWithState(run, f"site {kind}, start timestamp, x double, p double, loglik double", "x double, p double, ll double, last long", "append", GroupStateTimeout.NoTimeout)


class _Levels(StatefulProcessor):
    """The filter of one series over its closed steps. Its state is x, p, loglik, the last step and the empty steps up to it."""

    def __init__(self, f: float, q: float, r: float, x0: float, p0: float, origin: int, step_ms: int, idle: int):
        self.f, self.q, self.r, self.x0, self.p0 = f, q, r, x0, p0
        self.origin, self.step_ms, self.idle = origin, step_ms, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("level", "x double, p double, ll double, step long, empty long")

    def _ahead(self, steps: int) -> tuple[float, float]:
        """Mean and variance that many steps after the initial state."""
        g = self.f * self.f
        gain = steps if g == 1 else (1 - g**steps) / (1 - g)
        return self.f**steps * self.x0, g**steps * self.p0 + self.q * gain

    def _through(self, now: tuple | None, until: int, out: list[tuple]) -> tuple | None:
        """Predict the empty steps before until, as rows of out; None when the series has been idle for too long."""
        while now is not None and now[3] + 1 < until:
            x, p, ll, step, empty = now
            now = (self.f * x, self.f * self.f * p + self.q, ll, step + 1, empty + 1)
            out.append((step + 1, *now[:3], 0))
            if empty + 1 >= self.idle:
                now = None
        return now

    def _keep(self, key: tuple, now: tuple | None, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if now is None:
            self.state.clear()
        else:
            self.state.update(now)
            self.handle.registerTimer((now[3] + 2) * self.step_ms)
        if out:
            frame = pd.DataFrame(out, columns=["step", "x", "p", "loglik", "n"])
            frame.insert(0, "site", [key[0]] * len(out))
            yield frame

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self.state.get() if self.state.exists() else None
        out: list[tuple] = []
        frame = pd.concat(list(rows)).sort_values("step")
        for step, y, n in zip(frame["step"].tolist(), frame["y"].tolist(), frame["n"].tolist(), strict=True):
            now = self._through(now, step, out)
            if now is None:
                x, p, ll = *self._ahead(max(1, step - self.origin + 1)), 0.0
            else:
                x, p, ll = self.f * now[0], self.f * self.f * now[1] + self.q, now[2]
            if n:
                s, e = p + self.r, y - x
                ll -= 0.5 * (math.log(2 * math.pi * s) + e * e / s)
                x, p = x + p / s * e, (1 - p / s) * p
            now = (x, p, ll, step, 0)
            out.append((step, x, p, ll, n))
        yield from self._keep(key, now, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            before, out = self.state.get(), []
            # Steps that end by the watermark are closed: those of them with events have been filtered before timers run.
            now = self._through(before, timerValues.getCurrentWatermarkInMs() // self.step_ms, out)
            if out:
                yield from self._keep(key, now, out)

    def close(self) -> None:
        pass


def stream_levels(events: DataFrame, site: str, ts: str, value: str, f: float, q: float, r: float, x0: float, p0: float, step_ms: int = 86_400_000, late: str = "2 days", origin_ms: int = 0, idle: int = 366) -> DataFrame:
    """(site, start, x, p, loglik, n): the filtered level of every closed step of a stream of events, in one query.

    The mean of a site a step is aggregated by windows, which the watermark closes, so that events of a hot site are combined
    before the shuffle. The filter of a site follows as a StatefulProcessor: steps with events reach it when they close, steps
    without are closed by an event-time timer and predicted through (n = 0). After idle empty steps in a row the state
    expires, and a site that returns starts again. A site's first step is predicted from (x0, p0) just before the step that
    starts at origin_ms. Events of null time are left out, those of closed steps too, which late_rows() counts; null values
    count as no event of their step. Results do not depend on the batches, as long as no event is late. In append mode; the
    session needs the RocksDB state store (ROCKSDB). A null site is a site of its own. Times without a zone are UTC.
    """
    at = F.col(ts)
    if dict(events.dtypes)[ts] == "timestamp_ntz":  # without a zone: UTC
        at = F.convert_timezone(F.lit("UTC"), F.current_timezone(), at).cast("timestamp")
    w = events.select(F.col(site).alias("site"), at.alias("ts"), F.col(value).cast("double").alias("v")).withWatermark("ts", late)
    w = w.groupBy("site", F.window("ts", f"{step_ms} milliseconds").alias("w")).agg(F.avg("v").alias("y"), F.count("v").alias("n"))
    steps = w.select("site", F.window_time("w").alias("at"), (F.unix_millis("w.start") / step_ms).cast("long").alias("step"), "y", "n")
    kind = dict(events.dtypes)[site]
    run = _Levels(f, q, r, x0, p0, origin_ms // step_ms, step_ms, idle)
    out = steps.groupBy("site").transformWithStateInPandas(run, f"site {kind}, step long, x double, p double, loglik double, n long", "append", "EventTime")
    return out.select("site", F.timestamp_millis(F.col("step") * step_ms).alias("start"), "x", "p", "loglik", "n")


#: The state store that stateful processors need: option and value of a session.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after their step was closed, over the progress that the query still holds."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


def replayed(out: DataFrame) -> DataFrame:
    """All rows that a stream gives for what its source holds now, as a table in the shared folder.

    The table is removed with that folder.
    """
    spark = out.sparkSession
    path = f"{shared(spark)}/stream-{uuid.uuid4()}"
    before = spark.conf.get(ROCKSDB[0], None)
    spark.conf.set(*ROCKSDB)
    try:
        sink = out.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state")
        sink.trigger(availableNow=True).outputMode("append").start().awaitTermination()
    finally:
        spark.conf.unset(ROCKSDB[0]) if before is None else spark.conf.set(ROCKSDB[0], before)
    return spark.read.schema(out.schema).parquet(f"{path}/rows")
