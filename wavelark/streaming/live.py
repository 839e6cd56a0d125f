"""Streaming forms: windowed levels with watermarks, and regions by gap or likeness with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT, Config
from ..operators import logs


def windowed_levels(events: DataFrame, length: str = "4 seconds", slide: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """rms and n of (ts, value) by sliding window; rows later than `late` are dropped. TIMESTAMP_NTZ is cast first."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", length, slide)).agg(F.sqrt(F.avg(F.col("value") * F.col("value")) + 1e-12).alias("rms"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "rms", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a user's events without a pause of `gap`."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


def append_log(rows: DataFrame, path: str, kind: str, checkpoint: str, **trigger):
    """A running query that appends each micro-batch to a log; a batch that is run again after a failure replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        logs.append(batch, f"{path}/batch={number}", kind, mode="overwrite")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Progress(StreamingQueryListener):
    """Keeps (query name, batch, rows) of each micro-batch."""

    def __init__(self):
        self.seen: list[tuple[str | None, int, int]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.seen.append((event.progress.name, event.progress.batchId, event.progress.numInputRows))

    def onQueryTerminated(self, event) -> None:
        pass


REGION = "recording_id string, first_start double, last_start double, best_start double, best_score double, n long"
_STATE = "first double, last double, best double, score double, n long, embedding array<double>"


def live_regions(windows: DataFrame, cfg: Config = DEFAULT, idle: str = "processing") -> DataFrame:
    """A row for each region that has ended, of windows (recording_id, start_seconds, score, embedding) in order of arrival by start.

    State: the open region's bounds, best window, size and last embedding. A region ends at a gap or
    an unlike neighbour, or when its recording has been idle for a minute.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in REGION.split(", ")]
        if state.hasTimedOut:
            first, last, best, score, n, _ = state.get
            state.remove()
            yield pd.DataFrame([(key[0], first, last, best, score, n)], columns=names)
            return
        now = state.get if state.exists else None
        done = []
        for w in pd.concat(list(batches)).sort_values("start_seconds", kind="stable").itertuples():
            e = np.asarray(w.embedding, float)
            if now is not None:
                p = np.asarray(now[5], float)
                length = np.linalg.norm(p) * np.linalg.norm(e)
                same = w.start_seconds - now[1] <= cfg.region_gap_seconds and (p @ e / length if length else 0.0) >= cfg.region_similarity
                if not same:
                    done.append((key[0], *now[:5]))
                    now = None
            if now is None:
                now = (*[float(w.start_seconds)] * 3, float(w.score), 1, e.tolist())
            else:
                at, score = float(w.start_seconds), float(w.score)
                better = score > now[3]
                now = (now[0], at, at if better else now[2], max(score, now[3]), now[4] + 1, e.tolist())
        state.update(now)
        state.setTimeoutDuration(60_000)
        yield pd.DataFrame(done, columns=names)

    return windows.groupBy("recording_id").applyInPandasWithState(step, REGION, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RegionsInOrder(StatefulProcessor):
    """Regions of one recording, whatever the order in which its windows arrive.

    State: windows that the watermark has not passed yet (a list), the open region (a value), and how far
    windows have been taken. A timer stands at each waiting window and at the open region's longest
    pause. When the watermark passes them, windows are taken in order of time, and a region ends at a
    gap, at an unlike neighbour, or when nothing can follow any more. A window that comes after the
    watermark has passed it is late and is left out.
    """

    WAITING = "ms long, start_seconds double, score double, embedding array<double>"

    def __init__(self, gap: float, similarity: float):
        self.gap, self.similarity = gap, similarity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.WAITING)
        self.open = handle.getValueState("open", _STATE + ", ms long")
        self.taken = handle.getValueState("taken", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        upto = self.taken.get()[0] if self.taken.exists() else -(1 << 62)
        new = []
        for pdf in rows:
            for ts, w in zip(pdf["ts"], pdf.itertuples()):
                if (ms := int(ts.timestamp() * 1000)) > upto:
                    new.append((ms, float(w.start_seconds), float(w.score), [float(x) for x in w.embedding]))
        if new:
            self.waiting.appendList(new)
            for ms in {x[0] for x in new}:
                self.handle.registerTimer(ms)
        yield pd.DataFrame(columns=_names(REGION))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted((tuple(x) for x in waiting if x[0] <= mark), key=lambda x: (x[1], x[0]))
        rest = [tuple(x) for x in waiting if x[0] > mark]
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        now, done = tuple(self.open.get()) if self.open.exists() else None, []
        for ms, start, score, embedding in ready:
            if now is not None and not self._same(now, start, embedding):
                done.append((key[0], *now[:5]))
                now = None
            if now is None:
                now = (start, start, start, score, 1, embedding, ms)
            else:
                now = (now[0], start, start if score > now[3] else now[2], max(score, now[3]), now[4] + 1, embedding, ms)
        if now is not None:
            end = now[6] + int(self.gap * 1000) + 1  # no window up to here can be missing once the watermark is past it
            if mark >= end:
                done.append((key[0], *now[:5]))
                now = None
            else:
                self.handle.registerTimer(end)
        self.open.update(now) if now is not None else self.open.clear()
        self.taken.update((mark,))
        yield pd.DataFrame(done, columns=_names(REGION))

    def _same(self, now: tuple, start: float, embedding: list[float]) -> bool:
        p, e = np.asarray(now[5], float), np.asarray(embedding, float)
        length = np.linalg.norm(p) * np.linalg.norm(e)
        return start - now[1] <= self.gap and (p @ e / length if length else 0.0) >= self.similarity

    def close(self) -> None:
        pass


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def regions_in_order(windows: DataFrame, late: str = "30 seconds", cfg: Config = DEFAULT) -> DataFrame:
    """A row (REGION) for each region that has ended, of a stream of windows (recording_id, ts, start_seconds, score, embedding) that may be out of order by `late`.

    Regions are those of the batch form. ts is a window's place in event time. State of this kind is held in
    RocksDB, so the session is set to it.
    """
    windows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = windows.select("recording_id", F.col("ts").cast("timestamp").alias("ts"), "start_seconds", "score", "embedding").withWatermark("ts", late)
    return rows.groupBy("recording_id").transformWithStateInPandas(RegionsInOrder(cfg.region_gap_seconds, cfg.region_similarity), REGION, "Append", "EventTime")
