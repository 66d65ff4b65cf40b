"""Relay tables made of orders, customers, suppliers and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relay as R
from ..sources.tables import table
from . import query

_TYPES = ["image/png", "IMAGE/JPEG; q=1", "", "text/plain", "video/mp4"]
_TYPE = "(['image/png', 'IMAGE/JPEG; q=1', '', 'text/plain', 'video/mp4'])[1 + o_orderkey % 5]"
_NOW = "TIMESTAMP '1999-01-01 00:00:00'"
_BUNDLES = """bundles AS (SELECT o_orderkey AS bundle_id, o_custkey AS to_device_id, o_orderdate AS created_at, o_orderdate + INTERVAL 30 DAYS * (1 + o_orderkey % 40) AS expires_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END AS acked_at FROM orders)"""


def _bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.make_interval(days=(30 * (1 + F.col("o_orderkey") % 40)).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("bundle_id"), F.col("o_custkey").alias("to_device_id"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + days).alias("expires_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("acked_at"),
    )


def _or_none(column) -> F.Column:
    """Numbers with -1 for null, so that they stay whole numbers wherever they are compared."""
    return F.coalesce(column, F.lit(-1))


def _type() -> F.Column:
    return F.element_at(F.array(*map(F.lit, _TYPES)), (1 + F.col("o_orderkey") % 5).cast("int"))


@query(f"""
WITH u AS (SELECT o_orderkey AS bundle_id, o_custkey AS device_id, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE o_orderpriority || o_totalprice::DECIMAL(18, 2) END AS payload, {_TYPE} AS content_type, o_orderdate FROM orders),
d AS (SELECT c_custkey AS device_id, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey + 1 END AS paired FROM customer WHERE c_custkey % 7 <> 0),
r AS (SELECT u.*, d.paired, strlen(payload) AS size, CASE WHEN d.device_id IS NULL THEN 404 WHEN paired IS NULL THEN 422 WHEN payload = '' THEN 400 ELSE 201 END AS status FROM u LEFT JOIN d USING (device_id))
SELECT bundle_id, status, CASE WHEN status = 201 THEN paired ELSE -1 END AS to_device_id, CASE WHEN status = 201 THEN sha256(payload) END AS payload_hash, CAST(size AS INTEGER) AS payload_size,
  CASE WHEN status = 201 THEN coalesce(nullif(content_type, ''), 'application/octet-stream') END AS content_type, CASE WHEN status = 201 THEN epoch_us(o_orderdate + INTERVAL 30 DAYS) ELSE -1 END AS expires_us FROM r""")
def bundle_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.when(F.col("o_orderkey") % 17 == 0, "").otherwise(F.concat("o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)").cast("string")))
    uploads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bundle_id"), F.col("o_custkey").alias("device_id"), F.encode(payload, "UTF-8").alias("payload"), _type().alias("content_type"), F.col("o_orderdate").alias("created_at"))
    devices = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("device_id"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") + 1).alias("paired_device_id"))
    out = R.ingested(uploads, devices)
    return out.select("bundle_id", "status", _or_none("to_device_id").alias("to_device_id"), "payload_hash", "payload_size", "content_type", _or_none(F.unix_micros("expires_at")).alias("expires_us"))


@query(f"WITH {_BUNDLES} SELECT bundle_id, to_device_id, CAST(row_number() OVER (PARTITION BY to_device_id ORDER BY created_at DESC, bundle_id DESC) AS INTEGER) AS place FROM bundles WHERE acked_at IS NULL QUALIFY place <= 3")
def list_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pending(_bundles(spark, sf_dir), 3).select("bundle_id", "to_device_id", "place")


@query(f"""
WITH {_BUNDLES}, p AS (SELECT bundle_id, to_device_id, acked_at, row_number() OVER (PARTITION BY to_device_id, acked_at IS NULL ORDER BY created_at DESC, bundle_id DESC) AS n FROM bundles)
SELECT bundle_id, to_device_id, CAST(n - 3 AS INTEGER) AS place FROM p WHERE acked_at IS NULL AND n BETWEEN 4 AND 6""")
def list_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each device's page after the one that ends with its third bundle."""
    bundles = _bundles(spark, sf_dir)
    ends = R.pending(bundles, 3).where("place = 3").select("to_device_id", "bundle_id")
    paged = bundles.join(ends.select("to_device_id"), "to_device_id", "left_semi")
    return R.pending(paged, 3, before=ends).select("bundle_id", "to_device_id", "place")


@query(f"WITH {_BUNDLES}, r AS (SELECT o_orderkey AS bundle_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS device_id FROM orders) SELECT bundle_id, device_id, b.bundle_id IS NOT NULL AS found FROM r LEFT JOIN bundles b ON r.bundle_id = b.bundle_id AND r.device_id = b.to_device_id".replace("SELECT bundle_id, device_id, b.", "SELECT r.bundle_id, device_id, b."))
def bundle_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bundle_id"), asked.alias("device_id"))
    return R.owned(_bundles(spark, sf_dir), requests).select("bundle_id", "device_id", "found")


@query(f"""
WITH {_BUNDLES}, a AS (SELECT l_orderkey AS bundle_id, o_custkey + l_orderkey % 2 AS device_id, min(l_shipdate) AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT bundles.bundle_id, coalesce(epoch_us(coalesce(acked_at, a.ts)), -1) AS acked_us FROM bundles LEFT JOIN a ON a.bundle_id = bundles.bundle_id AND a.device_id = to_device_id""")
def bundle_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every second bundle is acknowledged by another device, which doesn't count.
    device = F.col("o_custkey") + F.col("o_orderkey") % 2
    owner = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bundle_id"), device.alias("device_id"))
    acks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bundle_id"), F.col("l_shipdate").alias("ts")).join(owner, "bundle_id")
    return R.acknowledged(_bundles(spark, sf_dir), acks).select("bundle_id", _or_none(F.unix_micros("acked_at")).alias("acked_us"))


@query(f"WITH {_BUNDLES} SELECT bundle_id FROM bundles WHERE NOT coalesce(acked_at < {_NOW} - INTERVAL 7 DAYS OR expires_at < {_NOW}, false)")
def bundle_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.retained(_bundles(spark, sf_dir), F.expr(_NOW)).select("bundle_id")


@query(f"SELECT o_orderkey AS bundle_id, lower(trim(split_part({_TYPE}, ';', 1))) IN ('image/gif', 'image/jpeg', 'image/png', 'image/webp', 'video/mp4') AS allowed FROM orders")
def media_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bundle_id"), R.media_allowed(_type()).alias("allowed"))


_PAIRING = "p AS (SELECT o_orderkey AS session_id, CASE o_orderstatus WHEN 'F' THEN 'cancelled' ELSE 'pending' END AS status, o_orderdate AS created_at, o_orderdate + INTERVAL 60 DAYS AS expires_at FROM orders)"
_DONE = f"{_PAIRING}, r AS (SELECT l_orderkey AS session_id, min((l_shipdate, l_suppkey)) AS r FROM lineitem GROUP BY l_orderkey), c AS (SELECT p.*, r.r, coalesce(status = 'pending' AND r.r[1] < expires_at, false) AS done FROM p LEFT JOIN r USING (session_id))"


def _pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "cancelled").otherwise("pending")
    sessions = o.select(F.col("o_orderkey").alias("session_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("expires_at"), F.lit(None).cast("long").alias("responder"))
    requests = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_shipdate").alias("ts"), F.col("l_suppkey").alias("responder"))
    return R.expired(R.completed(sessions, requests), F.expr(_NOW))


@query(f"WITH {_DONE.replace('min((l_shipdate, l_suppkey))', 'arg_min([epoch_us(l_shipdate), l_suppkey], (l_shipdate, l_suppkey))').replace('r.r[1] < expires_at', 'r.r[1] < epoch_us(expires_at)')} SELECT session_id, CASE WHEN done THEN 'completed' WHEN status = 'pending' AND expires_at < {_NOW} THEN 'expired' ELSE status END AS status, CASE WHEN done THEN r[2] ELSE -1 END AS responder FROM c")
def pairing_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairing(spark, sf_dir).select("session_id", "status", _or_none("responder").alias("responder"))


@query(f"WITH {_DONE.replace('min((l_shipdate, l_suppkey))', 'arg_min([epoch_us(l_shipdate), l_suppkey], (l_shipdate, l_suppkey))').replace('r.r[1] < expires_at', 'r.r[1] < epoch_us(expires_at)')} SELECT session_id FROM c WHERE done OR NOT (status = 'pending' AND expires_at < {_NOW} AND created_at < {_NOW} - INTERVAL 24 HOURS)")
def pairing_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.swept(_pairing(spark, sf_dir), F.expr(_NOW)).select("session_id")


@query("WITH d AS (SELECT c_custkey AS device_id, CASE WHEN c_custkey % 10 = 9 THEN NULL WHEN c_custkey % 3 = 0 THEN c_custkey + 1 WHEN c_custkey % 3 = 1 THEN c_custkey - 1 ELSE c_custkey + 2 END AS paired_device_id FROM customer) SELECT a.device_id, a.paired_device_id, coalesce(b.paired_device_id = a.device_id, false) AS mutual FROM d a LEFT JOIN d b ON a.paired_device_id = b.device_id WHERE a.paired_device_id IS NOT NULL")
def pair_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    other = F.when(c % 10 == 9, None).when(c % 3 == 0, c + 1).when(c % 3 == 1, c - 1).otherwise(c + 2)
    return R.paired(table(spark, sf_dir, "customer").select(c.alias("device_id"), other.alias("paired_device_id")))


_BOUNDS = "(SELECT 1024 * CAST(pow(2, i) AS BIGINT) AS le FROM range(15) t(i) UNION ALL SELECT NULL)"


@query(f"WITH b AS (SELECT {_TYPE} AS content_type, CAST(o_totalprice * 50 AS BIGINT) AS size FROM orders) SELECT content_type, coalesce(le, -1) AS le, count(CASE WHEN le IS NULL OR size <= le THEN 1 END) AS n FROM b CROSS JOIN {_BOUNDS} GROUP BY content_type, le")
def size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.size_histogram(table(spark, sf_dir, "orders").select(_type().alias("content_type"), F.rint(F.col("o_totalprice") * 50).cast("long").alias("size"))).withColumn("le", _or_none("le"))


@query("WITH r AS (SELECT user_id % 5 AS route, 200 + 100 * (event_id % 4) AS status, value FROM events) SELECT route, CASE WHEN status >= 500 THEN 'error' WHEN status >= 400 THEN 'warn' ELSE 'info' END AS level, count(*) AS requests, round(avg(value), 6) AS mean_ms, max(value) AS worst_ms FROM r GROUP BY ALL")
def request_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("route"), R.log_level(200 + 100 * (F.col("event_id") % 4)).alias("level"), "value")
    return rows.groupBy("route", "level").agg(F.count(F.lit(1)).alias("requests"), F.round(F.avg("value"), 6).alias("mean_ms"), F.max("value").alias("worst_ms"))


@query("SELECT s_suppkey AS device_id, sha256(s_name) AS fingerprint, '{\"session_id\":\"' || s_suppkey || '\",\"fingerprint\":\"' || sha256(s_name) || '\",\"code\":\"' || lpad((s_suppkey * 7919 % 1000000 // 1000)::VARCHAR, 3, '0') || '-' || lpad((s_suppkey * 7919 % 1000)::VARCHAR, 3, '0') || '\"}' AS payload FROM supplier")
def device_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import short_code

    mark = R.fingerprint(F.encode("s_name", "UTF-8"))
    payload = R.pairing_payload(F.col("s_suppkey").cast("string"), mark, short_code(F.col("s_suppkey") * 7919))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("device_id"), mark.alias("fingerprint"), payload.alias("payload"))
