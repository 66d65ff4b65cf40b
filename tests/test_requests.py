"""Streams with state against their batch operators, over several batches and a restart."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpuskiln.operators import events as E
from corpuskiln.operators import relay
from corpuskiln.streaming.changes import notices
from corpuskiln.streaming.requests import bundle_lives, delivered, error_rings, first_ids, here, limited, unrevoked

T0 = datetime(2024, 1, 1)
LATER = T0 + timedelta(days=400)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


class Fed:
    """A stream fed by files, a batch for each; it stops and starts again from its checkpoint between feeds."""

    def __init__(self, spark, folder, out, **schemas):
        self.spark, self.folder, self.schemas, self.fed = spark, folder, schemas, 0
        self.out = out

    def feed(self, **batches):
        for name, schema in self.schemas.items():
            for k, rows in enumerate(batches.get(name, [])):
                self.fed += 1
                self.spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(self.folder / name / f"{self.fed:03d}-{k}"))
        streams = {n: self.spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(str(self.folder / n / "*")) for n, s in self.schemas.items()}
        writer = self.out(**streams).writeStream.format("parquet").option("checkpointLocation", str(self.folder / "ck")).trigger(availableNow=True)
        query = writer.start(str(self.folder / "out"))
        assert query.awaitTermination(240)
        self.batches = query.lastProgress["batchId"] + 1 if query.lastProgress else 0
        return self.spark.read.parquet(str(self.folder / "out"))


def parts(rows, n, key):
    """Rows in n batches in time order, each in any order."""
    rows, rng, out = sorted(rows, key=key), random.Random(1), []
    for k in range(n):
        some = rows[k * len(rows) // n : (k + 1) * len(rows) // n]
        rng.shuffle(some)
        out.append(some)
    return out


def same(got, want):
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.select(*got.columns).collect()), key=repr)


def test_first_ids(spark, tmp_path):
    rng = random.Random(2)
    schema = "device string, key string, ts timestamp, seq long"
    rows = [(rng.choice("ab"), rng.choice(["k", "l", "", None]), at(rng.randrange(0, 6 * 24) * 1800), i) for i in range(80)]
    rows += [("c", "k", at(0), 100), ("c", "k", at(24 * 3600 - 1), 101), ("c", "k", at(24 * 3600), 102)]
    fed = Fed(spark, tmp_path, first_ids, uploads=schema)
    batches = parts(rows, 4, lambda r: (r[2], r[3]))
    fed.feed(uploads=batches[:2])
    got = fed.feed(uploads=batches[2:])
    assert fed.batches >= 4
    same(got, E.replays(spark.createDataFrame(rows, schema)))


def test_limited(spark, tmp_path):
    rng = random.Random(3)
    schema = "key string, ts timestamp, seq long"
    rows = [(rng.choice(["a", "b", "", None]), at(rng.randrange(0, 400)), i) for i in range(90)]
    fed = Fed(spark, tmp_path, lambda requests: limited(requests, 3, "1 minute"), requests=schema)
    batches = parts(rows, 3, lambda r: (r[1], r[2]))
    fed.feed(requests=batches[:1])
    same(fed.feed(requests=batches[1:]), E.rate_limited(spark.createDataFrame(rows, schema), 3, "1 minute"))


def test_unrevoked(spark, tmp_path):
    asked, revoked = "token string, ts timestamp, n long", "token string, since timestamp, until timestamp"
    requests = [(t, at(s), i) for i, (t, s) in enumerate((t, s) for t in ("a", "b", "c", None) for s in (0, 99, 100, 150, 199, 200, 250))]
    bans = [("a", at(100), at(200)), ("b", at(0), at(100)), ("b", at(90), at(120)), (None, at(0), at(300))]
    end = ("end", LATER, 0), ("end", LATER, LATER)
    fed = Fed(spark, tmp_path, lambda requests, bans: unrevoked(requests, bans, "1 hour", "10 minutes"), requests=asked, bans=revoked)
    # a's revocation comes a batch after the requests it holds back.
    fed.feed(requests=parts(requests, 2, lambda r: r[1]), bans=[bans[1:]])
    got = fed.feed(requests=[[end[0]], [("end", LATER, 1)]], bans=[bans[:1], [end[1]]])
    same(got.where("token is null or token <> 'end'"), E.not_revoked(spark.createDataFrame(requests, asked), spark.createDataFrame(bans, revoked)))


def test_a_revocation_that_is_too_long_stops_the_stream(spark, tmp_path):
    fed = Fed(spark, tmp_path, lambda requests, bans: unrevoked(requests, bans, "1 hour"), requests="token string, ts timestamp", bans="token string, since timestamp, until timestamp")
    with pytest.raises(Exception, match="lasts longer"):
        fed.feed(requests=[[("a", T0)]], bans=[[("a", T0, at(3601))]])


def test_presence(spark, tmp_path):
    rng = random.Random(4)
    schema = "device string, ts timestamp"
    rows = [(d, at(s)) for d, start in (("a", 0), ("b", 7)) for s in (start, start + 39, start + 78, start + 200, start + 200, start + 239.999)]
    rows += [("edge", at(0)), ("edge", at(40)), ("edge", at(80.001))] + [("c", at(rng.randrange(0, 900))) for _ in range(40)]
    fed = Fed(spark, tmp_path, here, beats=schema)
    batches = parts(rows, 3, lambda r: r[1])
    fed.feed(beats=batches[:2])
    got = fed.feed(beats=[*batches[2:], [("end", LATER)]]).where("device <> 'end'")
    spans = got.where("change = 'gone'").select("device", "start", F.col("at").alias("end"), "beats")
    same(spans, E.presence(spark.createDataFrame(rows, schema)))
    changes = got.select("device", F.col("at").alias("ts"), F.when(F.col("delta") > 0, 1).otherwise(0).alias("seq"), "delta")
    gauge = [r.open for r in E.open_connections(changes).collect()]
    assert set(gauge) == {0, 1}


def test_delivered(spark, tmp_path):
    conns, notes = "device string, connection string, ts timestamp, delta int", "device string, message string, ts timestamp"
    changes = [("d", "1", at(10), 1), ("d", "2", at(20), 1), ("d", "1", at(30), -1), ("d", "3", at(500), 1), ("x", "9", at(0), 1), ("d", "1", at(40), 1), ("d", "7", at(5), -1)]
    messages = [("d", f"m{s}", at(s)) for s in (9, 10, 15, 20, 29, 30, 40, 60)] + [("none", "m", at(15))]
    fed = Fed(spark, tmp_path, lambda messages, connections: delivered(messages, connections, "2 minutes"), messages=notes, connections=conns)
    # Messages come before the openings and closings that they depend on.
    fed.feed(messages=[messages[:4], messages[4:]], connections=[changes[3:5]])
    got = fed.feed(connections=[changes[:3] + changes[5:], [("end", "1", LATER, 1)]], messages=[[("end", "m", LATER)]])
    spans = spark.createDataFrame([("d", "1", at(10), at(30)), ("d", "1", at(40), LATER), ("d", "2", at(20), LATER), ("x", "9", at(0), LATER)], "device string, connection string, since timestamp, until timestamp")
    want = E.fan_out(spark.createDataFrame(messages, notes), spans).where("ts >= since and ts < until").withColumnRenamed("ts", "at")
    same(got.where("device <> 'end'"), want)


def test_published_messages_reach_open_connections(spark, tmp_path):
    device = "00000000-0000-0000-0000-00000000000a"
    published = [(f"sync:notify:{device}", "in time", at(50)), (f"sync:notify:{device}", "too late", at(70)), ("sync:notify:x", "no device", at(50)), ("other", "no", at(50)), (f"sync:notify:{device}", "end", LATER)]
    fed = Fed(spark, tmp_path, lambda published, connections: delivered(notices(published), connections), published="channel string, message string, ts timestamp", connections="device string, connection string, ts timestamp, delta int")
    got = fed.feed(published=[published[:4], published[4:]], connections=[[(device, "7", at(10), 1), (device, "7", at(60), -1)], [("end", "", LATER, 1)]])
    assert [(r.connection, r.message) for r in got.collect()] == [("7", "in time")]


def test_error_rings(spark, tmp_path):
    rng = random.Random(5)
    schema = "owner string, path string, ok boolean, ts timestamp, seq long"
    rows = [(rng.choice("ab"), f"/p{rng.randrange(9)}", rng.random() < 0.3, at(i * 3 + rng.randrange(3)), i) for i in range(150)]
    rows += [("c", "/one", False, at(1), 1000 + i) for i in range(15)] + [("c", "/one", True, at(400), 2000), ("e", "/x", False, at(9), 3000)]
    fed = Fed(spark, tmp_path, lambda runs: error_rings(runs, 4), runs=schema)
    batches = parts(rows, 3, lambda r: (r[3], r[4]))
    for k, batch in enumerate(batches):
        # What is later than the watermark's ten seconds is still held back.
        got = fed.feed(runs=[batch])
        seen = [r for b in batches[: k + 1] for r in b]
        passed = [r for r in seen if r[3] <= max(x[3] for x in seen) - timedelta(seconds=10)]
        last = got.groupBy("owner").agg(F.max("until").alias("until"))
        same(got.join(last, ["owner", "until"]).where("place > 0").select("owner", "path", "ts", "seq", "place"), E.recent_errors(spark.createDataFrame(passed, schema), 4))
    assert got.where("owner = 'c' and place = 0").count() == 1


def rings(got):
    last = got.groupBy(F.col("owner").alias("o")).agg(F.max("until").alias("u"))
    return got.join(last, F.col("owner").eqNullSafe(F.col("o")) & (F.col("until") == F.col("u"))).where("place > 0").select("owner", "path", "ts", "seq", "place")


def test_error_rings_of_an_owner_with_many_errors(spark, tmp_path):
    # Taken one by one, with all that are held read and written for each, these run into the feed's time limit.
    schema, n = "owner string, path string, ok boolean, ts timestamp, seq long", 9000
    rows = [("a", f"/p{i}", False, at(i), i) for i in range(n)] + [("a", f"/p{i}", True, at(n + i), n + i) for i in range(0, n, 2)]
    fed = Fed(spark, tmp_path, lambda runs: error_rings(runs, 4), runs=schema)
    fed.feed(runs=parts(rows, 2, lambda r: r[3]))
    got = fed.feed(runs=[[("end", "/", True, LATER, 0)], [("end", "/", True, LATER + timedelta(days=1), 0)]])
    same(rings(got.where("owner = 'a'")), E.recent_errors(spark.createDataFrame(rows, schema), 4))
    assert [r.seq for r in rings(got).orderBy("place").collect()] == [n - 1, n - 3, n - 5, n - 7]


def test_error_rings_with_nulls(spark, tmp_path):
    # A run whose ok is null is neither, an error without a path stays, and runs without an owner are one owner's; numbers stay exact beside nulls.
    rng = random.Random(6)
    schema = "owner string, path string, ok boolean, ts timestamp, seq long"
    rows = [(rng.choice(["a", None]), rng.choice(["/x", "/y", "/z", None]), rng.choice([True, False, False, None]), at(i), 2**53 + i if i % 9 else None) for i in range(120)]
    fed = Fed(spark, tmp_path, lambda runs: error_rings(runs, 4), runs=schema)
    fed.feed(runs=parts(rows, 3, lambda r: r[3]))
    got = fed.feed(runs=[[("end", "/", True, LATER, 0)], [("end", "/", True, LATER + timedelta(days=1), 0)]])
    # The batch operator joins by owner, too, so its clearing needs one.
    named = spark.createDataFrame(rows, schema).fillna("none", ["owner"])
    same(rings(got.where("owner is null or owner <> 'end'")).fillna("none", ["owner"]), E.recent_errors(named, 4))


def test_late_runs_do_not_change_a_ring(spark, tmp_path):
    schema = "owner string, path string, ok boolean, ts timestamp, seq long"
    fed = Fed(spark, tmp_path, lambda runs: error_rings(runs, 4), runs=schema)
    fed.feed(runs=[[("a", "/x", False, at(0), 0)], [("a", "/y", False, at(1000), 1)], [("a", "/y", False, at(2000), 2)]])
    # The success came after its time's runs were taken, with a run that is in time.
    got = fed.feed(runs=[[("a", "/x", True, at(5), 3), ("a", "/z", False, at(3000), 4)], [("end", "/", True, LATER, 0)], [("end", "/", True, LATER + timedelta(days=1), 0)]])
    assert [r.path for r in rings(got.where("owner = 'a'")).orderBy("place").collect()] == ["/z", "/y", "/y", "/x"]


def test_bundle_lives(spark, tmp_path):
    made, said = "bundle_id string, to_device_id string, created_at timestamp, expires_at timestamp", "bundle_id string, device_id string, ts timestamp"
    day = 86400
    bundles = [(f"b{i}", f"d{i % 3}", at(i * day), at((i + 30) * day)) for i in range(12)] + [("b3", "d9", at(4 * day), at(5 * day))]
    acks = [(f"b{i}", f"d{i % 3}", at((i + 2 * i + 1) * day)) for i in range(0, 12, 2)] + [("b1", "d0", at(2 * day)), ("b4", "d1", at(60 * day)), ("none", "d0", at(2 * day)), ("b0", "d0", at(3 * day))]
    fed = Fed(spark, tmp_path, lambda bundles, acks: bundle_lives(bundles, acks), bundles=made, acks=said)
    first = spark.createDataFrame(bundles[:12], made).withColumn("acked_at", F.lit(None).cast("timestamp"))
    acked = relay.acknowledged(first, spark.createDataFrame(acks, said))
    got = None
    for days in (10, 20, 33, 45, 90):
        now = at(days * day + 60)
        some = lambda rows, k, low=getattr(test_bundle_lives, "low", T0 - timedelta(1)): [r for r in rows if low < r[k] <= now]
        # One row of each stream moves the watermark to a minute before: to `days`.
        got = fed.feed(bundles=[some(bundles, 2) + [("now", "n", now, LATER)]], acks=[some(acks, 2) + [("now", "x", now)]])
        test_bundle_lives.low = now
        state = got.where("bundle_id <> 'now'").groupBy("bundle_id").agg(F.max_by("change", F.struct("at", "change")).alias("change"))
        left = {r.bundle_id for r in state.where("change in ('kept', 'acked')").collect()}
        there = acked.where(F.col("created_at") <= F.lit(at(days * day))).withColumn("acked_at", F.when(F.col("acked_at") <= F.lit(at(days * day)), F.col("acked_at")))
        assert left == {r.bundle_id for r in relay.retained(there, F.lit(at(days * day))).collect()}, days
    assert {r.change for r in got.collect()} == {"kept", "acked", "expired", "acknowledged"}
