"""Requests, connections, errors and bundles as streams with state: each gives what its batch operator gives.

Every stream has a watermark: `late` behind the latest time seen. Rows that come later than that are dropped, by
Spark. Streams that must see a key's rows in time order (here, delivered, error_rings, bundle_lives) hold them back until the
watermark has passed them; the others answer at once, in time order within a batch. Times are of the events, never the clock's, so that a
stream that starts again, or catches up, gives the same rows. error_rings, whose owners are few and have many runs, packs them before it deals them
out, and keeps them so.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY, SECOND = 86_400_000_000, 1_000_000


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _rows(parts: Iterator[pd.DataFrame], names: list[str]) -> list[tuple]:
    """A batch's rows of one key in the order of their first two columns."""
    return sorted((tuple(r) for part in parts for r in part[names].astype(object).itertuples(index=False)), key=_when)


def _when(row: tuple) -> tuple:
    return row[:2]


def _ms(micros: int) -> int:
    return -(-micros // 1000)


def _keyed(rows: DataFrame, late: str | None, by: list[str], processor: StatefulProcessor, out: str) -> DataFrame:
    """late None: rows have their watermarks already, of several streams the one that is furthest behind holds."""
    rows = rows.withWatermark("ts", late) if late else rows
    return rows.groupBy(*by).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime")


class _Replays(StatefulProcessor):
    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.first = handle, handle.getValueState("first", "since long, seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.first.get() if self.first.exists() else None
        before, out = held, []
        for at, seq in _rows(rows, ["at", "seq"]):
            if held is None or at >= held[0] + self.keep:
                held = (at, seq)
            out.append((*key, seq, held[1], seq != held[1]))
        if held != before:
            self.first.update(held)
            self.handle.registerTimer(_ms(held[0] + self.keep))
        yield pd.DataFrame(out, columns=["device", "key", "seq", "original", "replayed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.first.exists() and self.first.get()[0] + self.keep <= timerValues.getCurrentWatermarkInMs() * 1000:
            self.first.clear()
        yield from ()

    def close(self) -> None:
        pass


def first_ids(uploads: DataFrame, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """A stream of (device, key, seq, original, replayed), as events.replays gives them, from one of uploads (device, key, ts, seq).

    Every upload gets an answer at once: the first one's seq, if it was less than so many hours earlier. A first one's state ends by a timer then.
    """
    rows = uploads.select("device", "key", "ts", F.unix_micros("ts").alias("at"), F.col("seq").cast("long"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"device {kinds['device']}, key {kinds['key']}, seq long, original long, replayed boolean"
    out = _keyed(rows.where("key is not null and key <> ''"), late, ["device", "key"], _Replays(hours * 3600 * SECOND), schema)
    free = rows.where("key is null or key = ''")
    return out.unionByName(free.select("device", "key", "seq", F.col("seq").alias("original"), F.lit(False).alias("replayed")))


class _Limit(StatefulProcessor):
    """A counter for each key and window; a timer at the window's end takes it away."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.count = handle, handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        if not n:
            self.handle.registerTimer(_ms(key[2]))
        out = []
        for at, seq in _rows(rows, ["at", "seq"]):
            n += 1
            out.append((key[0], at, seq, n <= self.limit))
        self.count.update((n,))
        yield pd.DataFrame(out, columns=["key", "at", "seq", "accepted"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.count.clear()
        yield from ()

    def close(self) -> None:
        pass


def limited(requests: DataFrame, limit: int, window: str, late: str = "1 minute") -> DataFrame:
    """A stream of (key, ts, seq, accepted), as events.rate_limited decides, from one of requests (key, ts, seq): a row a request, at once."""
    rows = requests.select("key", "ts", F.unix_micros("ts").alias("at"), F.col("seq").cast("long"), F.window("ts", window).alias("w"))
    rows = rows.select("key", "ts", "at", "seq", F.unix_micros("w.start").alias("start"), F.unix_micros("w.end").alias("end"))
    kind = dict(rows.dtypes)["key"]
    out = _keyed(rows.where("key is not null and key <> ''"), late, ["key", "start", "end"], _Limit(limit), f"key {kind}, at long, seq long, accepted boolean")
    free = rows.where("key is null or key = ''").select("key", "at", "seq", F.lit(True).alias("accepted"))
    return out.unionByName(free).select("key", F.timestamp_micros("at").alias("ts"), "seq", "accepted")


def unrevoked(requests: DataFrame, revoked: DataFrame, longest: str = "24 hours", late: str = "1 minute") -> DataFrame:
    """A stream of the requests (token, ts, ...) that events.not_revoked keeps, from two streams; revoked is (token, since, until).

    A request is given once the watermarks of both have passed it, so that a revocation that comes late still holds it back. No revocation may be
    longer than `longest` (a token's lifetime), by which state ends; one that is stops the stream.
    """
    within = F.col("until") <= F.col("since") + F.expr(f"INTERVAL {longest}")
    sound = F.when(within, True).otherwise(F.raise_error(f"a revocation lasts longer than {longest}").cast("boolean"))
    r = revoked.where(sound).select(F.col("token").alias("_token"), "since", "until").withWatermark("since", late)
    on = (F.col("token") == F.col("_token")) & (F.col("ts") >= F.col("since")) & (F.col("ts") < F.col("until")) & (F.col("ts") <= F.col("since") + F.expr(f"INTERVAL {longest}"))
    return requests.withWatermark("ts", late).join(r, on, "left_outer").where("_token is null").select(*requests.columns)


class _InOrder(StatefulProcessor):
    """Holds a key's rows (at, seq, ...) until the watermark has passed them, then takes them in that order."""

    columns: str
    out: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.waiting = handle, handle.getListState("waiting", self.columns)
        self.begin(handle)

    def begin(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def take(self, key: tuple, row: tuple) -> Iterable[tuple]:
        raise NotImplementedError

    def due(self) -> int | None:
        """When something happens without a row."""
        return None

    def happens(self, key: tuple, at: int) -> Iterable[tuple]:
        return ()

    def shown(self, key: tuple) -> Iterable[tuple]:
        """What is given after rows have been taken."""
        return ()

    def _passed(self, key: tuple, rows: list[tuple], until: int) -> Iterator[pd.DataFrame]:
        ready = [r for r in rows if r[0] <= until]
        out: list[tuple] = []
        for row in ready:
            while (due := self.due()) is not None and due < row[0]:
                out += self.happens(key, due)
            out += self.take(key, row)
        while (due := self.due()) is not None and due <= until:
            out += self.happens(key, due)
        if ready:
            out += self.shown(key)
        rest = rows[len(ready) :]
        self.waiting.put(rest) if rest else self.waiting.clear()
        times = [t for t in (rest[0][0] if rest else None, self.due()) if t is not None]
        if times:
            self.handle.registerTimer(_ms(min(times)))
        if out:
            yield pd.DataFrame(out, columns=_names(self.out)).astype(object)

    def _held(self) -> list[tuple]:
        return [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        every = sorted([*self._held(), *_rows(rows, _names(self.columns))], key=_when)
        yield from self._passed(key, every, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._passed(key, sorted(self._held(), key=_when), timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def _timed(rows: DataFrame, *micros: str) -> DataFrame:
    return rows.withColumns({c: F.timestamp_micros(c) for c in micros})


class _Presence(_InOrder):
    columns, out = "at long, seq long", "device {}, at long, change string, delta int, start long, beats long"

    def __init__(self, quiet: int, device: str) -> None:
        self.quiet, self.out = quiet, self.out.format(device)

    def begin(self, handle) -> None:
        self.span = handle.getValueState("span", "start long, last long, beats long")

    def due(self) -> int | None:
        return self.span.get()[1] + self.quiet if self.span.exists() else None

    def happens(self, key, at) -> Iterable[tuple]:
        start, _, beats = self.span.get()
        self.span.clear()
        return [(*key, at, "gone", -1, start, beats)]

    def take(self, key, row) -> Iterable[tuple]:
        at, n = row
        if self.span.exists():
            start, _, beats = self.span.get()
            self.span.update((start, at, beats + 1))
            return ()
        self.span.update((at, at, 1))
        return [(*key, at, "here", 1, at, 0)]


def here(beats: DataFrame, quiet_s: float = 40, late: str = "10 seconds") -> DataFrame:
    """A stream of (device, at, change, delta, start, beats) from heartbeats (device, ts): "here" (+1) with a device's first one, "gone" (-1)
    when none has come for so long, by a timer, with the span's start and number of beats. Spans are events.presence's; the sum of delta is the gauge."""
    rows = beats.select("device", "ts", F.unix_micros("ts").alias("at"), F.lit(0).cast("long").alias("seq"))
    processor = _Presence(int(quiet_s * SECOND), dict(rows.dtypes)["device"])
    return _timed(_keyed(rows, late, ["device"], processor, processor.out), "at", "start")


class _Delivery(_InOrder):
    columns, out = "at long, seq long, kind int, what string", "device string, connection string, message string, at long"

    def begin(self, handle) -> None:
        self.open = handle.getMapState("open", "connection string", "since long")

    def take(self, key, row) -> Iterable[tuple]:
        at, _, kind, what = row
        if kind == 0 and self.open.containsKey((what,)):
            self.open.removeKey((what,))
        elif kind == 1:
            self.open.updateValue((what,), (at,))
        elif kind == 2:
            return [(*key, connection, what, at) for (connection,) in list(self.open.keys())]
        return ()


def delivered(messages: DataFrame, connections: DataFrame, late: str = "10 seconds") -> DataFrame:
    """A stream of (device, connection, message, at): messages (device, message, ts) to each connection that is open at their time.

    connections is a stream of (device, connection, ts, delta), delta 1 for opened and -1 for closed. A message at the time
    of an opening is delivered, at that of a closing isn't; one without an open connection is dropped.
    """
    kind = F.when(F.col("delta") < 0, 0).otherwise(1)
    known = connections.select(F.col("device").cast("string"), "ts", kind.alias("kind"), F.col("connection").cast("string").alias("what"))
    said = messages.select(F.col("device").cast("string"), "ts", F.lit(2).alias("kind"), F.col("message").cast("string").alias("what"))
    rows = known.withWatermark("ts", late).unionByName(said.withWatermark("ts", late)).withColumns({"at": F.unix_micros("ts"), "seq": F.col("kind").cast("long")})
    return _timed(_keyed(rows, None, ["device"], _Delivery(), _Delivery.out), "at")


#: So many runs, or bytes of them, are packed at once. A run without a number comes before those that have one.
_PACK, _PACK_BYTES, _NO_NUMBER = 1 << 16, 1 << 26, -(1 << 63)
_RUN = pa.schema([("at", pa.int64()), ("seq", pa.int64()), ("ok", pa.int8()), ("path", pa.string())])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (owner, at, seq, ok, path) one for each owner, with the last time and lists of the runs."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _PACK or sum(b.nbytes for b in held) >= _PACK_BYTES:
            yield _by_owner(pa.Table.from_batches(held))
            held = []
    if any(b.num_rows for b in held):
        yield _by_owner(pa.Table.from_batches(held))


def _by_owner(rows: pa.Table) -> pa.RecordBatch:
    if rows["at"].null_count:
        raise ValueError("a run has no time")
    codes = pc.dictionary_encode(rows["owner"].combine_chunks(), null_encoding="encode").indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    rows = rows.take(order)
    offsets = pa.array(np.append(starts, len(order)), pa.int32())
    runs = [pa.ListArray.from_arrays(offsets, rows[f.name].combine_chunks().cast(f.type)) for f in _RUN]
    last = np.maximum.reduceat(rows["at"].to_numpy(), starts)
    return pa.RecordBatch.from_arrays([rows["owner"].take(starts).combine_chunks(), pa.array(last), *runs], ["owner", "last", *_RUN.names])


class _Ring(StatefulProcessor):
    """Holds an owner's runs until the watermark has passed them; a walk over them in order then leaves the errors that no success has cleared.

    Both are kept as Arrow batches: those of waiting runs by their first time, so that only what is due is read again.
    """

    out = "owner string, path string, at long, seq long, place int, until long"

    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.taken = handle, handle.getValueState("taken", "until long")
        self.waiting = handle.getMapState("waiting", "first long, number long", "runs binary")
        self.errors = handle.getMapState("errors", "number long", "runs binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = []
        for frame in rows:
            at, seq, ok, path = (np.concatenate([np.asarray(x) for x in frame[c]]) for c in _RUN.names)
            parts.append(pa.RecordBatch.from_arrays([pa.array(at), pa.array(seq), pa.array(ok), pa.array(path, pa.string(), from_pandas=True)], schema=_RUN))
        yield from self._passed(key, pa.Table.from_batches(parts, _RUN), timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._passed(key, _RUN.empty_table(), timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass

    @staticmethod
    def _read(state, numbers: list[tuple]) -> pa.Table:
        return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(bytes(state.getValue(n)[0])), _RUN) for n in numbers], _RUN)

    @staticmethod
    def _listed(runs: pa.Table) -> Iterator[tuple]:
        return zip(*(runs[c].to_numpy().tolist() for c in _RUN.names), strict=True)

    @staticmethod
    def _parts(runs: pa.Table) -> Iterator[pa.RecordBatch]:
        for k in range(0, runs.num_rows, _PACK):
            yield runs.slice(k, _PACK).combine_chunks().to_batches()[0]

    def _passed(self, key: tuple, new: pa.Table, until: int) -> Iterator[pd.DataFrame]:
        if (taken := self.taken.get()[0] if self.taken.exists() else None) is not None:
            new = new.filter(pc.greater(new["at"], taken))  # late ones, packed with others
        numbers = sorted(tuple(n) for n in self.waiting.keys())
        due = [n for n in numbers if n[0] <= until]
        runs = pa.concat_tables([self._read(self.waiting, due), new])
        # An error at the time and number of a success comes first, and is cleared.
        order = np.lexsort([runs[c].to_numpy() for c in ("ok", "seq", "at")])
        runs = runs.take(order)
        ready = int(np.searchsorted(runs["at"].to_numpy(), until, "right"))
        for n in due:
            self.waiting.removeKey(n)
        firsts, number = [n[0] for n in numbers[len(due) :]], max((n[1] for n in numbers), default=0)
        for part in self._parts(runs.slice(ready)):
            firsts.append(part["at"][0].as_py())
            number += 1
            self.waiting.updateValue((firsts[-1], number), (part.serialize().to_pybytes(),))
        if firsts:
            self.handle.registerTimer(_ms(min(firsts)))
        if taken is None or taken < until:
            self.taken.update((until,))
        if ready:
            yield pd.DataFrame(self._ring(key, runs.slice(0, ready)), columns=_names(self.out), dtype=object)

    def _ring(self, key: tuple, runs: pa.Table) -> list[tuple]:
        errors: dict[str | None, list[tuple[int, int]]] = {}
        numbers, changed = sorted(tuple(n) for n in self.errors.keys()), False
        for at, seq, _, path in self._listed(self._read(self.errors, numbers)):
            errors.setdefault(path, []).append((at, seq))
        for at, seq, ok, path in self._listed(runs):
            if ok == 0:
                own = errors.setdefault(path, [])
                own.append((at, seq))
                if len(own) > self.most:  # more of one path than the ring has places can't show
                    del own[0]
                changed = True
            elif ok == 1 and path is not None and errors.pop(path, None):
                changed = True
        if changed:
            held = [(at, seq, 0, path) for path, own in errors.items() for at, seq in own]
            parts = list(self._parts(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _RUN, strict=True)], schema=_RUN))) if held else []
            for k, part in enumerate(parts):
                self.errors.updateValue((k,), (part.serialize().to_pybytes(),))
            for n in numbers[len(parts) :]:
                self.errors.removeKey(n)
        until = runs["at"][-1].as_py()
        last = heapq.nlargest(self.most, ((at, seq, path is not None, path or "") for path, own in errors.items() for at, seq in own))
        return [(*key, path if known else None, at, seq if seq != _NO_NUMBER else None, k + 1, until) for k, (at, seq, known, path) in enumerate(last)] or [(*key, None, None, None, 0, until)]


def error_rings(runs: DataFrame, most: int = 10, late: str = "10 seconds") -> DataFrame:
    """A stream of owners' rings (owner, path, ts, seq, place, until) as events.recent_errors has them, from runs (owner, path, ok, ts, seq).

    An owner's whole ring is given whenever its runs up to `until` have been taken, place 1 the latest error; an empty one is a row with place 0. The rows
    with an owner's largest until are its ring. A path's errors go with its success; a run whose ok is null is neither. Runs come to the state in
    lists, so a late one that is in a list with others is dropped if its owner's runs of that time have been taken, else taken.
    """
    ok = F.when(F.col("ok"), 1).when(~F.col("ok"), 0).otherwise(-1).cast("tinyint")
    rows = runs.select(F.col("owner").cast("string"), F.unix_micros("ts").alias("at"), F.coalesce(F.col("seq").cast("long"), F.lit(_NO_NUMBER)).alias("seq"), ok.alias("ok"), F.col("path").cast("string"))
    packed = rows.mapInArrow(_packed, "owner string, last long, at array<long>, seq array<long>, ok array<tinyint>, path array<string>")
    timed = packed.select("owner", F.timestamp_micros("last").alias("ts"), *_RUN.names)
    return _timed(_keyed(timed, late, ["owner"], _Ring(most), _Ring.out), "at", "until").withColumnRenamed("at", "ts")


class _Life(_InOrder):
    columns, out = "at long, seq long, device string, expires long", "bundle_id string, to_device_id string, at long, change string"

    def __init__(self, acked: int) -> None:
        self.acked = acked

    def begin(self, handle) -> None:
        self.bundle = handle.getValueState("bundle", "device string, expires long, acked long")

    def due(self) -> int | None:
        if not self.bundle.exists():
            return None
        _, expires, acked = self.bundle.get()
        return min(expires, acked + self.acked if acked >= 0 else expires) + 1

    def happens(self, key, at) -> Iterable[tuple]:
        device, expires, _ = self.bundle.get()
        self.bundle.clear()
        return [(*key, device, at, "expired" if at == expires + 1 else "acknowledged")]

    def take(self, key, row) -> Iterable[tuple]:
        at, kind, device, expires = row
        if kind == 0 and not self.bundle.exists():
            self.bundle.update((device, expires, -1))
            return [(*key, device, at, "kept")]
        if kind == 1 and self.bundle.exists():
            held = self.bundle.get()
            if held[0] == device and held[2] < 0:
                self.bundle.update((device, held[1], at))
                return [(*key, device, at, "acked")]
        return ()


def bundle_lives(bundles: DataFrame, acks: DataFrame, acked_days: int = 7, late: str = "1 minute") -> DataFrame:
    """A stream of what happens to bundles: (bundle_id, to_device_id, at, change), change one of kept, acked, expired, acknowledged.

    bundles is a stream of (bundle_id, to_device_id, created_at, expires_at), acks of (bundle_id, device_id, ts). The first acknowledgement of the device that
    a bundle is for counts. Timers give "expired" just after expires_at, or "acknowledged" so many days after the acknowledgement; what was kept and
    had neither by some time is what relay.retained leaves at that time.
    """
    made = bundles.select(F.col("bundle_id").cast("string"), F.col("created_at").alias("ts"), F.lit(0).alias("seq"), F.col("to_device_id").cast("string").alias("device"), F.unix_micros("expires_at").alias("expires"))
    said = acks.select(F.col("bundle_id").cast("string"), "ts", F.lit(1).alias("seq"), F.col("device_id").cast("string").alias("device"), F.lit(0).cast("long").alias("expires"))
    rows = made.withWatermark("ts", late).unionByName(said.withWatermark("ts", late)).withColumns({"at": F.unix_micros("ts"), "seq": F.col("seq").cast("long")})
    return _timed(_keyed(rows, None, ["bundle_id"], _Life(acked_days * DAY), _Life.out), "at")
