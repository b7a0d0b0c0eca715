"""Trackers whose state has types and an end: value, list and map state, closed by event-time timers.

A series' burst is a run of pulses without a pause of more than ``idle``
seconds. While it is open its state holds the filters (a value), the last
intervals (a list) and the pulses of each channel (a map). It is closed by the
series' next pulse, or by a timer once the watermark has passed its last pulse
by ``idle``; one row is given then and the state goes, so that series that stop
leave nothing behind. The state of open bursts can come from a batch run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulseloom.operators import scan

CLOSED = "series_id long, start_s double, end_s double, n long, channels long, kalman_filtered double, ewma double, sma double"
FILTERS = "start double, last double, n long, x double, p double, s double"
OPEN = "series_id long, " + FILTERS + ", recent array<double>, channels map<string, long>"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Bursts(StatefulProcessor):
    """Kalman filter, exponential mean and mean of the last intervals of each burst."""

    def __init__(self, idle: float, q: float, r: float, p0: float, alpha: float, rows: int):
        self.idle, self.q, self.r, self.p0, self.alpha, self.rows = idle, q, r, p0, alpha, rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.filters = handle.getValueState("filters", FILTERS)
        self.recent = handle.getListState("recent", "z double")
        self.channels = handle.getMapState("channels", "channel string", "n long")

    def _closed(self, key, state: tuple, recent: list[float], channels: dict) -> tuple:
        start, last, n, x, _, s = state
        return (key[0], start, last, n + 1, len(channels), x if n else None, s if n else None, sum(recent) / len(recent) if recent else None)

    def _held(self) -> tuple[tuple | None, list[float], dict]:
        if not self.filters.exists():
            return None, [], {}
        return tuple(self.filters.get()), [r[0] for r in self.recent.get()], {k[0]: v[0] for k, v in self.channels.iterator()}

    def _clear(self) -> None:
        self.filters.clear()
        self.recent.clear()
        self.channels.clear()

    def _store(self, state: tuple, recent: list[float], channels: dict) -> None:
        self._clear()
        self.filters.update(state)
        if recent:
            self.recent.put([(z,) for z in recent])
        for channel, n in channels.items():
            self.channels.updateValue((channel,), (n,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((state[1] + self.idle) * 1000) + 1)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples(index=False):
            state = (float(row.start), float(row.last), int(row.n), float(row.x), float(row.p), float(row.s))
            recent = [] if row.recent is None else [float(z) for z in row.recent]
            pairs = row.channels.items() if isinstance(row.channels, dict) else (row.channels or [])
            self._store(state, recent, {k: int(v) for k, v in pairs})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, recent, channels = self._held()
        pdf, out = pd.concat(list(rows)).sort_values(["toa_s", "event_id"]), []
        for t, channel in zip(pdf["toa_s"].tolist(), pdf["channel"].tolist()):
            if state is not None and t < state[1]:
                continue  # late: its interval can't be undone
            if state is not None and t - state[1] > self.idle:
                out.append(self._closed(key, state, recent, channels))
                state, recent, channels = None, [], {}
            channels[channel] = channels.get(channel, 0) + 1
            if state is None:
                state = (t, t, 0, 0.0, self.p0, 0.0)
                continue
            start, last, n, x, p, s = state
            z = t - last
            x, s = (x, s) if n else (z, z)
            ahead = p + self.q
            gain = ahead / (ahead + self.r)
            recent = [*recent, z][-self.rows :]
            state = (start, t, n + 1, x + gain * (z - x), (1 - gain) * ahead, self.alpha * z + (1 - self.alpha) * s)
        if state is not None:
            self._store(state, recent, channels)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, recent, channels = self._held()
        due = state is not None and expiredTimerInfo.getExpiryTimeInMs() >= int((state[1] + self.idle) * 1000)
        if due:
            self._clear()
        yield self._frame([self._closed(key, state, recent, channels)] if due else [])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in CLOSED.split(", ")])

    def close(self) -> None:
        pass


def bursts(idle: float = 86_400.0, q: float = 1e8, r: float = 1e8, p0: float = 1e8, alpha: float = 0.2, rows: int = 10, initial: DataFrame | None = None) -> Callable[[DataFrame], DataFrame]:
    """An operator for ``tracking.replay``: pulses with a watermark -> a row (see CLOSED) for each burst that has ended.

    initial: open bursts of a batch run (see OPEN), of which a series has one at most.
    """

    def run(pulses: DataFrame) -> DataFrame:
        spark = pulses.sparkSession
        # Types of state and timers need the store that keeps column families.
        spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        first = initial.groupBy("series_id") if initial is not None else None
        return pulses.groupBy("series_id").transformWithStateInPandas(Bursts(idle, q, r, p0, alpha, rows), CLOSED, "Append", "EventTime", first)

    return run


def open_bursts(pulses: DataFrame, idle: float = 86_400.0, q: float = 1e8, r: float = 1e8, p0: float = 1e8, alpha: float = 0.2, rows: int = 10) -> DataFrame:
    """The state (see OPEN) of the last burst of each series of a batch (series_id, k, toa_s, channel)."""
    over, whole = Window.partitionBy("series_id").orderBy("k"), Window.partitionBy("series_id")
    cut = pulses.withColumn("z", F.col("toa_s") - F.lag("toa_s").over(over))
    cut = cut.withColumn("_no", F.sum(F.coalesce(F.col("z") > idle, F.lit(True)).cast("int")).over(over))
    last = cut.withColumn("_last", F.max("_no").over(whole)).filter("_no = _last").drop("_no", "_last").withColumn("_i", F.row_number().over(over) - 1)
    channels = last.groupBy("series_id", "channel").agg(F.count("*").alias("n")).groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("channel", "n"))).alias("channels"))
    ends = last.groupBy("series_id").agg(F.min("toa_s").alias("start"), F.max("toa_s").alias("last"), (F.count("*") - 1).alias("n"))
    gaps = last.filter("_i > 0").select("series_id", (F.col("_i") - 1).cast("long").alias("k"), F.col("z").alias("delta_t_s"))
    tracked = scan.scan(gaps, [scan.Kalman(q, r, p0, float("inf")), scan.Ewma(alpha=alpha)]).withColumn("_back", F.max("k").over(whole) - F.col("k"))
    ahead = F.col("kalman_variance") - r
    tail = tracked.filter(F.col("_back") < rows).groupBy("series_id").agg(
        F.max_by("kalman_filtered", "k").alias("x"), F.max_by((1 - ahead / F.col("kalman_variance")) * ahead, "k").alias("p"), F.max_by("ewma", "k").alias("s"),
        F.transform(F.array_sort(F.collect_list(F.struct("k", "delta_t_s"))), lambda e: e["delta_t_s"]).alias("recent"),
    )
    out = ends.join(channels, "series_id").join(tail, "series_id", "left")
    zero = [F.coalesce(c, F.lit(v)).alias(c) for c, v in (("x", 0.0), ("p", float(p0)), ("s", 0.0))]
    return out.select("series_id", "start", "last", "n", *zero, "recent", "channels")
