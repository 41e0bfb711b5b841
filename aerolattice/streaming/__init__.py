"""Structured Streaming forms of the station operators. Event times are timestamps here, as watermarks need them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import thermal as T
from ..operators.tables import upsert_keep_last


def stream_observations(spark: SparkSession, folder: str, flatten: Callable[[DataFrame, str], DataFrame], variable: str, files: int = 100) -> DataFrame:
    """Long rows of the payloads that arrive in a folder, ``files`` of them in a batch at most."""
    raw = spark.readStream.schema("value string").option("wholetext", True).option("maxFilesPerTrigger", files).format("text").load(folder)
    rows = flatten(raw.select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("source_file")), variable)
    return rows.withColumn("event_time", F.try_to_timestamp("timestamp"))


def with_event_time(df: DataFrame, primary: str, fallback: str, late: str = "72 hours") -> DataFrame:
    """The primary time, else the fallback, with a watermark; rows without either are dropped."""
    return df.withColumn("event_time", F.coalesce(primary, fallback)).filter("event_time is not null").withWatermark("event_time", late)


def arrival_flags(df: DataFrame, fetched: str, late: str = "72 hours", jitter: str = "6 minutes") -> DataFrame:
    """``is_late`` (older than the age limit when it was fetched) and ``is_early`` (ahead of the fetch by more than clocks
    may differ), so that late rows are counted and not only dropped by a watermark."""
    at, got = F.col("event_time"), F.col(fetched)
    return df.withColumns({"is_late": at < got - F.expr(f"interval {late}"), "is_early": at > got + F.expr(f"interval {jitter}")})


def dedup_stream(df: DataFrame, keys: Sequence[str], late: str = "72 hours") -> DataFrame:
    """The first row of each key within the watermark; state is dropped beyond it. ``upsert_batches`` keeps the last."""
    return df.withWatermark("event_time", late).dropDuplicatesWithinWatermark(list(keys))


def tumbling_hour(df: DataFrame, value: str, late: str = "2 hours") -> DataFrame:
    w = df.withWatermark("event_time", late).groupBy(F.window("event_time", "1 hour"), "station_id")
    return w.agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), F.percentile_approx(value, 0.9).alias("p90"), F.count(value).alias("n")).select(F.col("window.start").alias("hour"), "station_id", "mean", "max", "min", "p90", "n")


def sliding_3h(df: DataFrame, value: str, late: str = "2 hours") -> DataFrame:
    w = df.withWatermark("event_time", late).groupBy(F.window("event_time", "3 hours", "15 minutes"), "station_id")
    return w.agg(F.avg(value).alias("mean_3h")).select(F.col("window.end").alias("at"), "station_id", "mean_3h")


def pair_stream(obs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Observations joined with a static table of snapshots (``station_id, valid_hour``) by their hour."""
    return obs.withColumn("valid_hour", F.date_trunc("hour", "event_time")).join(snapshots, ["station_id", "valid_hour"], "left")


def pair_streams(obs: DataFrame, snapshots: DataFrame, late: str = "3 hours") -> DataFrame:
    """Two streams: an observation waits for a snapshot whose valid hour holds it; state goes with the watermarks."""
    o = obs.withWatermark("event_time", late)
    s = snapshots.select(F.col("station_id").alias("s_station"), "valid_hour", "temp").withWatermark("valid_hour", late)
    held = F.expr("station_id = s_station and event_time >= valid_hour and event_time < valid_hour + interval 1 hour")
    return o.join(s, held, "leftOuter")


def silent_station(df: DataFrame, gap: str = "90 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each station; a session that has closed means silence since its end."""
    w = df.withWatermark("event_time", late).groupBy(F.session_window("event_time", gap), "station_id")
    return w.agg(F.count("*").alias("rows")).select("station_id", F.col("session_window.start").alias("from"), F.col("session_window.end").alias("silent_since"), "rows")


# Minutes without a row of a station, and what they mean.
SILENCE = ((30, "YELLOW"), (90, "RED"))


class SilenceWatch(StatefulProcessor):
    """Keeps each station's last event time and how many of the ``limits`` it has passed; a timer stands at the next one."""

    def __init__(self, limits: Sequence[tuple[int, str]] = SILENCE):
        self.limits = list(limits)

    def init(self, handle) -> None:
        self.handle, self.seen = handle, handle.getValueState("seen", "last long, passed int")

    def _alarms(self, station: str, last: int, passed: int, until: int) -> tuple[list[tuple], int]:
        """The alarms of a silence from ``last`` on that are due at ``until`` (both in ms) and weren't given yet."""
        out = []
        while passed < len(self.limits) and last + 60_000 * self.limits[passed][0] <= until:
            minutes, level = self.limits[passed]
            out.append((station, last // 1000, last // 1000 + 60 * minutes, minutes, level))
            passed += 1
        return out, passed

    def _keep(self, last: int, passed: int) -> None:
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        self.seen.update((last, passed))
        if passed < len(self.limits):
            self.handle.registerTimer(last + 60_000 * self.limits[passed][0])

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["station_id", "silent_since", "alarm_at", "minutes", "level"])

    def handleInputRows(self, key, rows, timerValues):
        """Times in ascending order; a silence between two of them is told too, if it is over when the later one arrives."""
        times = sorted({int(t.value // 1_000_000) for part in rows for t in part["event_time"]})
        last, passed = self.seen.get() if self.seen.exists() else (times[0], 0)
        out: list[tuple] = []
        for t in times:
            if t > last:
                out += self._alarms(key[0], last, passed, t)[0]
                last, passed = t, 0
        self._keep(last, passed)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last, passed = self.seen.get()
        # The watermark may have passed several limits at once.
        due = max(int(expiredTimerInfo.getExpiryTimeInMs()), int(timerValues.getCurrentWatermarkInMs()))
        out, passed = self._alarms(key[0], last, passed, due)
        self._keep(last, passed)
        yield self._frame(out)


def silence_alarms(df: DataFrame, late: str = "10 minutes", limits: Sequence[tuple[int, str]] = SILENCE) -> DataFrame:
    """``station_id, silent_since, alarm_at, minutes, level``: an alarm for each limit that a station's silence passes, while it
    lasts: event-time timers tell it as soon as the watermark, ``late`` behind the newest row of all stations, passes the
    limit. A row of the station sets its timers anew. Rows without a time are dropped, and rows behind the watermark change
    nothing. The state is one row for each station. The session needs the RocksDB state store (``ROCKSDB``)."""
    rows = df.filter("event_time is not null and station_id is not null").withWatermark("event_time", late).groupBy("station_id")
    schema = "station_id string, silent_since long, alarm_at long, minutes int, level string"
    return rows.transformWithStateInPandas(SilenceWatch(limits), schema, "append", "EventTime")


#: The setting that streams with timers need: its name and value.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def alert_stream(cell_hours: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hourly alert of a stream of cell hours (``event_time, cell, wbgt_c, utci_c``). Of a cell's rows in an hour the first
    counts, so the number of cells is exact."""
    once = cell_hours.withWatermark("event_time", late).withColumn("_hour", F.date_trunc("hour", "event_time")).dropDuplicatesWithinWatermark(["_hour", "cell"])
    e = once.groupBy(F.window("event_time", "1 hour")).agg(
        F.count("*").alias("cells"), F.max("wbgt_c").alias("max_wbgt_c"), F.max("utci_c").alias("max_utci_c"), F.count_if(F.col("wbgt_c") >= 33).alias("hi"), F.count_if(F.col("wbgt_c") >= 31).alias("mod"),
        *(F.count_if(F.col("utci_c") >= c).alias(f"u{c}") for c in (26, 32, 38, 46)),
    )
    wb = T.wbgt_alert(F.col("hi"), F.col("mod"), F.col("max_wbgt_c"), F.col("cells"))
    ut = T.utci_alert(*(F.col(c) for c in ("u46", "u38", "u32", "u26", "max_utci_c", "cells")))
    return e.select(F.col("window.start").alias("hour"), "cells", "max_wbgt_c", "max_utci_c", wb.alias("wbgt_alert"), ut.alias("utci_alert"), T.combined_alert(wb, ut).alias("alert"))


def upsert_batches(path: str, manifest: str, keys: Sequence[str], order: Sequence[str], day: str = "obs_date") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: merges a batch into a partitioned archive, the last row of a key wins, and writes one manifest
    row for the batch. A batch that runs again merges to the same archive."""
    from ..sources.archive import merge_into_archive

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = upsert_keep_last(batch.limit(0), batch, [*keys, day], order)
        if not batch.limit(1).count():
            return
        facts = batch.agg(F.count("*").alias("rows"), F.count_distinct("station_id").alias("stations"), F.count_if(F.col("value").isNull()).alias("missing")).first()
        added = merge_into_archive(spark, batch, path, keys, order, day).first()
        row = (batch_id, facts.rows, added.rows_added, facts.stations, ["missing values"] if facts.missing else [])
        spark.createDataFrame([row], "batch_id long, rows_fetched long, rows_added long, stations long, warnings array<string>").write.mode("overwrite").parquet(f"{manifest}/batch_id={batch_id}")

    return run
