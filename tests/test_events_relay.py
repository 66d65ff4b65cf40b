from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpuskiln.functions import text as T
from corpuskiln.operators import events, relay
from corpuskiln.sources.files import strip_frontmatter

T0 = datetime(2024, 1, 1)


def test_sessions_part_only_above_the_gap(spark):
    at = [T0, T0 + timedelta(seconds=10), T0 + timedelta(seconds=20, microseconds=1), T0 + timedelta(hours=5)]
    rows = spark.createDataFrame(list(enumerate(at)), "seq long, ts timestamp")
    assert [r.session for r in events.sessions(rows, 10).orderBy("seq").collect()] == [1, 1, 2, 3]


def test_replays(spark):
    rows = [("d", "k", T0 + timedelta(hours=h), i) for i, h in enumerate((0, 23, 24, 30))] + [("d", None, T0, 9), ("d", "", T0, 10)]
    got = {r.seq: r.original for r in events.replays(spark.createDataFrame(rows, "device string, key string, ts timestamp, seq long")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 9: 9, 10: 10}


def test_rate_limit_lets_keyless_requests_pass(spark):
    rows = spark.createDataFrame([("", T0, i) for i in range(3)] + [("a", T0, i) for i in range(3, 6)], "key string, ts timestamp, seq long")
    assert events.rate_limited(rows, 1, "1 minute").where("accepted").count() == 4


def test_relay_flow(spark):
    devices = spark.createDataFrame([(1, 2), (2, 1), (3, None)], "device_id long, paired_device_id long")
    uploads = spark.createDataFrame([(10, 1, b"hello sync bundle payload", None, T0), (11, 3, b"x", "a/b", T0), (12, 1, b"", "a/b", T0), (13, 9, b"x", "", T0)], "bundle_id long, device_id long, payload binary, content_type string, created_at timestamp")
    got = {r.bundle_id: r for r in relay.ingested(uploads, devices).collect()}
    assert {k: r.status for k, r in got.items()} == {10: 201, 11: 422, 12: 400, 13: 404}
    assert got[10].payload_size == 25 and got[10].to_device_id == 2 and got[10].content_type == relay.DEFAULT_TYPE
    bundles = spark.createDataFrame([(10, 2, T0, T0 + timedelta(days=30), None)], "bundle_id long, to_device_id long, created_at timestamp, expires_at timestamp, acked_at timestamp")
    assert relay.pending(bundles).count() == 1
    acked = relay.acknowledged(bundles, spark.createDataFrame([(10, 2, T0 + timedelta(days=1)), (10, 5, T0)], "bundle_id long, device_id long, ts timestamp"))
    assert acked.first().acked_at == T0 + timedelta(days=1) and relay.pending(acked).count() == 0
    assert relay.retained(acked, F.lit(T0 + timedelta(days=7))).count() == 1
    assert relay.retained(acked, F.lit(T0 + timedelta(days=9))).count() == 0
    assert [r.mutual for r in relay.paired(devices).collect()] == [True, True]
    big = spark.createDataFrame([(1, 1, b"x" * 2048, "a/b", T0)], "bundle_id long, device_id long, payload binary, content_type string, created_at timestamp")
    assert relay.ingested(big, devices, most_mb=0.001).first().status == 413


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(strip_frontmatter(F.lit("---\ntitle: Hello\n---\n\n# Heading\n"))) == "# Heading\n"
    assert one(strip_frontmatter(F.lit("---\r\na: 1\r\n---\r\nx"))) == "x"
    assert one(strip_frontmatter(F.lit("---\nnot closed"))) == "---\nnot closed"
    assert one(T.iso8601(F.lit(-5))) == "1970-01-01T00:00:00Z"
    assert one(T.extension(F.lit("/a/.hidden"))) == "" and one(T.extension(F.lit("/a.b/c.Md"))) == "Md"
    assert one(T.short_code(F.lit(1234567))) == "234-567"
    assert one(T.path_tail(F.lit("x" * 60))) == "…" + "x" * 49
    assert one(T.rpc_error(F.lit('{"jsonrpc":"2.0","id":1,"method":"nope"}'))) == T.NO_METHOD
    assert one(T.rpc_error(F.lit('{"jsonrpc":"2.0","method":"nope"}'))) is None
