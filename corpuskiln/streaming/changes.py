"""File events as streams: debouncing, indexing, limits, replays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.embedding import Embedder
from ..operators.events import last_writers
from ..operators.store import Store
from ..plans.search import index_read
from ..sources.files import read_paths


class Debounce(StatefulProcessor):
    """Holds the last kind of each path until no event has come for `quiet_ms`; then gives them all.

    Any event moves the one deadline of its watcher. Deadlines are looked at when a batch runs.
    """

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", "path string", "kind string, ts timestamp, seq long")
        self.deadline = handle.getValueState("deadline", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for path, kind, ts, seq in part[["path", "kind", "ts", "seq"]].itertuples(index=False):
                held = self.paths.getValue((path,)) if self.paths.containsKey((path,)) else None
                if held is None or (held[1], held[2]) <= (ts.to_pydatetime(), seq):
                    self.paths.updateValue((path,), (kind, ts.to_pydatetime(), int(seq)))
        if self.deadline.exists():
            self.handle.deleteTimer(self.deadline.get()[0])
        at = timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms
        self.deadline.update((at,))
        self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = [(key[0], p[0], v[0]) for p, v in self.paths.iterator()]
        self.paths.clear()
        self.deadline.clear()
        if rows:
            yield pd.DataFrame(rows, columns=["watcher", "path", "kind"])

    def close(self) -> None:
        pass


def debounced(events: DataFrame, quiet_ms: int = 500) -> DataFrame:
    """A stream of (watcher, path, kind) from one of (watcher, path, kind, ts, seq).

    One deadline holds for all of a watcher's paths, so a watcher is a key; many watchers are spread
    over tasks.
    """
    return events.groupBy("watcher").transformWithStateInPandas(
        statefulProcessor=Debounce(quiet_ms), outputStructType="watcher string, path string, kind string", outputMode="Append", timeMode="ProcessingTime"
    )


def arrivals(spark: SparkSession, folder: str, names: str = "*") -> DataFrame:
    """A stream of events (path, kind, ts, seq) of files as they come into a folder, also below it.

    Only listings are read, no contents. A file that changes later or goes is not seen; `sources.changes` sees those.
    """
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", names).option("recursiveFileLookup", "true").load(folder)
    at = F.col("modificationTime")
    return found.select("path", F.lit("upsert").alias("kind"), at.alias("ts"), F.unix_micros(at).alias("seq"))


def indexing(events: DataFrame, store: Store, embedder: Embedder, checkpoint: str, read: Callable[[DataFrame], DataFrame] = read_paths, on_results: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
    """A writer that keeps the store up to date with events (path, kind, ts, seq), one change of the store for each batch.

    read gives a row (path, text, file_type, last_modified, line_offset, reason) for every upserted path (path), as read_paths does. Files
    that it says are missing go, as do removed ones; one that it can't read or that has no reader is a reject and keeps what the
    store has. A batch that runs again leaves the same rows. on_results is called for each batch with what became of its paths
    (path, result, reason) and the batch's number, as `Totals.results`.
    """

    def apply(batch: DataFrame, number: int) -> None:
        last = last_writers(batch, "path").persist()
        try:
            told = None if on_results is None else lambda results: on_results(results, number)
            index_read(store, read(last.where("kind = 'upsert'").select("path")), embedder, gone=last.where("kind = 'remove'"), on_results=told)
        finally:
            last.unpersist()

    seen = events.observe("index_events", F.count(F.when(F.col("kind") == "upsert", 1)).alias("upserts"), F.count(F.when(F.col("kind") == "remove", 1)).alias("removes"))
    return seen.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


class Totals(StreamingQueryListener):
    """Counters of indexing streams: events as the streams' progress reports them, and results as `results` is told of them.

    A batch that runs again counts once. spark.streams.addListener(totals) makes it hear of all of the session's streams; it heeds those of `indexing`.
    """

    def __init__(self) -> None:
        self._events: dict[tuple, dict[str, int]] = {}
        self._results: dict[int, dict[str, int]] = {}

    def results(self, results: DataFrame, batch: int) -> None:
        self._results[batch] = {r["result"]: r["n"] for r in results.groupBy("result").agg(F.count(F.lit(1)).alias("n")).collect()}

    def counters(self) -> dict[str, int]:
        """upserts and removes seen; indexed, rejected and removed paths."""
        total = dict.fromkeys(("upserts", "removes", "indexed", "rejected", "removed"), 0)
        for counts in (*self._events.values(), *self._results.values()):
            for name, n in counts.items():
                total[name] += n
        return total

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        found = progress.observedMetrics.get("index_events")
        if found is not None and progress.numInputRows:
            self._events[str(progress.id), progress.batchId] = {"upserts": found["upserts"], "removes": found["removes"]}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def first_uploads(uploads: DataFrame, hours: int = 24) -> DataFrame:
    """Uploads (device, key, ts, ...) without replays of a device's key, by a watermark on ts."""
    return uploads.withWatermark("ts", f"{hours} hours").dropDuplicatesWithinWatermark(["device", "key"])


def request_counts(requests: DataFrame, limit: int, window: str, late: str = "1 minute") -> DataFrame:
    """Per key and fixed window how many requests came and how many were within the limit."""
    counted = requests.withWatermark("ts", late).groupBy("key", F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return counted.select("key", F.col("w.start").alias("start"), "requests", F.least("requests", F.lit(limit)).alias("accepted"))


def notices(channels: DataFrame) -> DataFrame:
    """Messages of the subscribed channels (channel, message, ...) with the device that a channel names.

    A channel that isn't `sync:notify:` and a UUID is skipped. As `messages` of requests.delivered they reach the connections that are open at their time.
    """
    device = F.regexp_extract("channel", r"^sync:notify:([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})$", 1)
    return channels.withColumn("device", device).where("device <> ''")


def notified(channels: DataFrame, connections: DataFrame) -> DataFrame:
    """Published messages (channel, message) for each connection (device, ...) of a table of open ones."""
    return notices(channels).join(connections, "device")
