"""Change events and requests: debouncing, last writers, limits, replays, presence, errors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def classified(kind: Column, path: Column, to: Column, exists: Column) -> Column:
    """What a raw change comes to: an array of (path, kind), in order; empty if nothing.

    kind is one of create, data, metadata, other, rename_both, rename_from, rename_to, rename, remove;
    anything else is dropped. exists says whether the path is there now.
    """
    one = lambda p, k: F.struct(p.alias("path"), F.lit(k).alias("kind"))
    upsert, remove = F.array(one(path, "upsert")), F.array(one(path, "remove"))
    none = F.filter(upsert, lambda _: F.lit(False))
    out = F.when(kind.isin("create", "data", "metadata", "rename_to"), upsert).when(kind.isin("remove", "rename_from"), remove)
    out = out.when(kind == "rename_both", F.array(one(path, "remove"), one(to, "upsert")))
    out = out.when(kind == "rename", F.when(exists, upsert).otherwise(remove)).when((kind == "other") & exists, upsert)
    return out.otherwise(none)


def sessions(events: DataFrame, gap_s: float) -> DataFrame:
    """Adds session (from 1) to events (ts, seq): a quiet time longer than gap_s parts two sessions.

    One deadline for all events is a total order, but no task sees all of them: events are ordered
    within seconds, one row for each second within hours, and only one row for each hour as a whole.
    """
    rows = events.withColumns({"_hour": F.date_trunc("hour", "ts"), "_second": F.date_trunc("second", "ts")})
    hour, day = Window.partitionBy("_hour").orderBy("_second"), Window.orderBy("_hour")
    seconds = rows.groupBy("_hour", "_second").agg(F.max("ts").alias("last"))
    hours = seconds.groupBy("_hour").agg(F.max("last").alias("last")).select("_hour", F.lag("last").over(day).alias("_earlier"))
    before = seconds.select("_hour", "_second", F.lag("last").over(hour).alias("_before")).join(hours, "_hour")
    before = before.select("_hour", "_second", F.coalesce("_before", "_earlier").alias("_before"))
    within = Window.partitionBy("_hour", "_second").orderBy("ts", "seq")
    rows = rows.join(before, ["_hour", "_second"]).withColumn("_previous", F.coalesce(F.lag("ts").over(within), "_before"))
    apart = F.unix_micros("ts") - F.unix_micros("_previous") > int(gap_s * 1_000_000)
    rows = rows.withColumn("_new", F.when(apart | F.col("_previous").isNull(), 1).otherwise(0))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("_hour", "_second").agg(F.sum("_new").alias("n"))
    ahead = starts.groupBy("_hour").agg(F.sum("n").alias("n")).select("_hour", earlier(day).alias("_ahead"))
    starts = starts.select("_hour", "_second", earlier(hour).alias("_offset")).join(ahead, "_hour")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(starts, ["_hour", "_second"]).withColumn("session", (F.col("_ahead") + F.col("_offset") + F.sum("_new").over(upto)).cast("long"))
    return out.select(*events.columns, "session")


def last_writers(events: DataFrame, *by: str) -> DataFrame:
    """The last kind for each key, by (ts, seq)."""
    return events.groupBy(*by).agg(F.max_by("kind", F.struct("ts", "seq")).alias("kind"))


def reconciled(events: DataFrame, present: DataFrame) -> DataFrame:
    """events (path, kind) as the disk has it: what isn't among present paths is a removal."""
    here = present.select("path", F.lit(True).alias("_here")).distinct()
    return events.join(here, "path", "left").withColumn("kind", F.when(F.col("_here"), "upsert").otherwise("remove")).drop("_here")


def watch_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): what to watch from now on and what no longer."""
    added = after.select("path").distinct().join(before, "path", "left_anti").withColumn("change", F.lit("watch"))
    return added.unionByName(before.select("path").distinct().join(after, "path", "left_anti").withColumn("change", F.lit("unwatch")))


def rate_limited(requests: DataFrame, limit: int, window: str, key: str = "key") -> DataFrame:
    """Adds accepted: the first `limit` requests of a key in each fixed window; all without a key."""
    place = Window.partitionBy(key, F.window("ts", window)).orderBy("ts", "seq")
    return requests.withColumn("accepted", F.coalesce(F.col(key) == "", F.lit(True)) | (F.row_number().over(place) <= limit))


def replays(uploads: DataFrame, hours: int = 24) -> DataFrame:
    """(device, key, seq, original, replayed) of uploads (device, key, ts, seq).

    A key's first upload is kept for so many hours; one of the same device and key within them is a
    replay of it, a later one is kept anew. Without a key nothing is replayed. Whether an upload is
    kept depends on the one kept before it, so a key's uploads are streamed in order; a task holds
    one batch of them and the last kept one.
    """
    keep = hours * 3_600_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, since, first = None, 0, 0
        for batch in batches:
            original = []
            for device, key, at, seq in zip(*(batch.column(c).to_pylist() for c in ("device", "key", "at", "seq")), strict=True):
                if (device, key) != last or at >= since + keep:
                    last, since, first = (device, key), at, seq
                original.append(first)
            seqs = batch.column("seq")
            out = pa.array(original, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("device"), batch.column("key"), seqs, out, pc.not_equal(seqs, out)], ["device", "key", "seq", "original", "replayed"])

    rows = uploads.select("device", "key", F.unix_micros("ts").alias("at"), F.col("seq").cast("long"))
    keyed = rows.where("key is not null and key <> ''").repartition("device", "key").sortWithinPartitions("device", "key", "at", "seq")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = keyed.mapInArrow(run, f"device {kinds['device']}, key {kinds['key']}, seq long, original long, replayed boolean")
    return out.unionByName(rows.where("key is null or key = ''").select("device", "key", "seq", F.col("seq").alias("original"), F.lit(False).alias("replayed")))


def not_revoked(requests: DataFrame, revoked: DataFrame) -> DataFrame:
    """Requests (token, ts) whose token isn't revoked at the time: revoked has (token, since, until)."""
    r = revoked.select(F.col("token").alias("_token"), "since", "until")
    return requests.join(r, (F.col("token") == F.col("_token")) & (F.col("ts") >= F.col("since")) & (F.col("ts") < F.col("until")), "left_anti")


def presence(beats: DataFrame, quiet: str = "40 seconds", key: str = "device") -> DataFrame:
    """Spans (key, start, end, beats) in which a device was heard at least so often."""
    return beats.groupBy(key, F.session_window("ts", quiet).alias("w")).agg(F.count(F.lit(1)).alias("beats")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "beats")


def open_connections(changes: DataFrame, key: str = "device") -> DataFrame:
    """Adds open: how many connections a key has after each change (ts, seq, delta).

    A key's changes are one task's, which streams them in order and can spill.
    """
    return changes.withColumn("open", F.sum("delta").over(Window.partitionBy(key).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)))


def recent_errors(runs: DataFrame, most: int = 10, key: str = "owner") -> DataFrame:
    """For each owner its last `most` errors (path, ts, seq) that no later success of the path cleared."""
    cleared = runs.where("ok").groupBy(key, "path").agg(F.max(F.struct("ts", "seq")).alias("_ok"))
    errors = runs.where("not ok").join(cleared, [key, "path"], "left").where(F.col("_ok").isNull() | (F.struct("ts", "seq") > F.col("_ok")))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("seq")))
    return errors.withColumn("place", place).where(F.col("place") <= most).select(key, "path", "ts", "seq", "place")


def last_success(runs: DataFrame, key: str = "owner") -> DataFrame:
    """When each owner's indexing last succeeded (null if never) and how many of its runs failed since."""
    last = runs.groupBy(key).agg(F.max(F.when(F.col("ok"), F.struct("ts", "seq"))).alias("_ok"))
    since = F.count(F.when(~F.col("ok") & (F.col("_ok").isNull() | (F.struct("ts", "seq") > F.col("_ok"))), 1))
    return runs.join(last, key).groupBy(key).agg(F.max("_ok.ts").alias("last_success"), since.alias("failed_since"))


def fan_out(notes: DataFrame, connections: DataFrame) -> DataFrame:
    """Every notification to every open connection of its device; without one it is dropped."""
    return notes.join(connections, "device")
