"""A store-and-forward relay's tables: bundles, pairing, retention, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of media taken, and days and hours things are kept.
MEDIA = ["image/gif", "image/jpeg", "image/png", "image/webp", "video/mp4"]
KEEP_DAYS, ACKED_DAYS, SESSION_MINUTES, SESSION_HOURS, PAGE = 30, 7, 5, 24, 20
DEFAULT_TYPE, MOST_MB = "application/octet-stream", 50


def ingested(uploads: DataFrame, devices: DataFrame, keep_days: int = KEEP_DAYS, most_mb: float = MOST_MB) -> DataFrame:
    """uploads (bundle_id, device_id, payload, content_type, created_at) with their fate.

    status is 201, 400 (empty), 404 (no such device), 413 (too large) or 422 (not paired); accepted
    rows have to_device_id, payload_hash (SHA-256 hex), payload_size and expires_at.
    """
    known = devices.select("device_id", "paired_device_id", F.lit(True).alias("_known"))
    rows = uploads.join(known, "device_id", "left").withColumn("payload_size", F.coalesce(F.octet_length("payload"), F.lit(0)))
    status = F.when(F.col("_known").isNull(), 404).when(F.col("paired_device_id").isNull(), 422).when(F.col("payload_size") == 0, 400).when(F.col("payload_size") > most_mb * 2**20, 413).otherwise(201)
    rows = rows.withColumn("status", status)
    taken = lambda c: F.when(F.col("status") == 201, c)
    return rows.select(
        "bundle_id", "device_id", "status", taken(F.col("paired_device_id")).alias("to_device_id"), taken(F.sha2("payload", 256)).alias("payload_hash"), "payload_size",
        taken(F.coalesce(F.nullif("content_type", F.lit("")), F.lit(DEFAULT_TYPE))).alias("content_type"), taken(F.col("created_at") + F.expr(f"INTERVAL {keep_days} DAYS")).alias("expires_at"),
    )


def media_allowed(content_type: Column) -> Column:
    return F.coalesce(F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1)))).isin(MEDIA), F.lit(False))


def pending(bundles: DataFrame, limit: int = PAGE, now: Column | None = None, before: DataFrame | None = None) -> DataFrame:
    """For each device its `limit` newest bundles that aren't acknowledged (and not expired at `now`).

    before (to_device_id, bundle_id): where a device's page begins: only what is older than that bundle. An unknown
    bundle, or none for a device, is the first page.
    """
    rows = bundles.where("acked_at is null")
    if before is not None:
        at = before.join(bundles, ["to_device_id", "bundle_id"]).select("to_device_id", F.struct("created_at", "bundle_id").alias("_at"))
        rows = rows.join(at, "to_device_id", "left").where(F.col("_at").isNull() | (F.struct("created_at", "bundle_id") < F.col("_at"))).drop("_at")
    rows = rows.where(F.col("expires_at") >= now) if now is not None else rows
    place = F.row_number().over(Window.partitionBy("to_device_id").orderBy(F.desc("created_at"), F.desc("bundle_id")))
    return rows.withColumn("place", place).where(F.col("place") <= limit)


def owned(bundles: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (bundle_id, device_id) with found: whether the bundle is there and is the device's."""
    own = bundles.select("bundle_id", F.col("to_device_id").alias("device_id"), F.lit(True).alias("_own"))
    return requests.join(own, ["bundle_id", "device_id"], "left").withColumn("found", F.coalesce("_own", F.lit(False))).drop("_own")


def acknowledged(bundles: DataFrame, acks: DataFrame) -> DataFrame:
    """Bundles with acked_at set where the device they are for acknowledged them; the first time stays."""
    first = acks.groupBy(F.col("bundle_id"), F.col("device_id").alias("to_device_id")).agg(F.min("ts").alias("_ack"))
    return bundles.join(first, ["bundle_id", "to_device_id"], "left").withColumn("acked_at", F.coalesce("acked_at", "_ack")).drop("_ack").select(*bundles.columns)


def retained(bundles: DataFrame, now: Column, acked_days: int = ACKED_DAYS) -> DataFrame:
    """Bundles that neither were acknowledged so many days before now nor have expired."""
    gone = (F.col("acked_at") < now - F.expr(f"INTERVAL {acked_days} DAYS")) | (F.col("expires_at") < now)
    return bundles.where(~F.coalesce(gone, F.lit(False)))


def completed(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """Pairing sessions after requests (session_id, ts, responder): pending ones in time are completed."""
    first = requests.groupBy("session_id").agg(F.min(F.struct("ts", "responder")).alias("_r"))
    rows = sessions.join(first, "session_id", "left")
    done = (F.col("status") == "pending") & (F.col("_r.ts") < F.col("expires_at"))
    return rows.withColumn("responder", F.when(done, F.col("_r.responder")).otherwise(F.col("responder"))).withColumn("status", F.when(F.coalesce(done, F.lit(False)), "completed").otherwise(F.col("status"))).select(*sessions.columns)


def expired(sessions: DataFrame, now: Column) -> DataFrame:
    """Pending sessions whose time is over become expired."""
    return sessions.withColumn("status", F.when((F.col("status") == "pending") & (F.col("expires_at") < now), "expired").otherwise(F.col("status")))


def swept(sessions: DataFrame, now: Column, hours: int = SESSION_HOURS) -> DataFrame:
    """Without expired sessions made so many hours before now."""
    return sessions.where(~F.coalesce((F.col("status") == "expired") & (F.col("created_at") < now - F.expr(f"INTERVAL {hours} HOURS")), F.lit(False)))


def paired(devices: DataFrame) -> DataFrame:
    """(device_id, paired_device_id, mutual): whether the other device names this one."""
    other = devices.select(F.col("device_id").alias("paired_device_id"), F.col("paired_device_id").alias("_back"))
    linked = devices.where("paired_device_id is not null").join(other, "paired_device_id", "left")
    return linked.select("device_id", "paired_device_id", F.coalesce(F.col("_back") == F.col("device_id"), F.lit(False)).alias("mutual"))


def size_histogram(bundles: DataFrame, buckets: int = 15, first: int = 1024) -> DataFrame:
    """For each content_type how many bundles are at most first * 2^i bytes, and all (le null)."""
    bounds = [first << i for i in range(buckets)]
    counts = bundles.groupBy("content_type").agg(*[F.count(F.when(F.col("size") <= b, 1)).alias(str(b)) for b in bounds], F.count(F.lit(1)).alias("all"))
    pairs = F.array(*[F.struct(F.lit(b).cast("long").alias("le"), F.col(f"`{b}`").alias("n")) for b in bounds], F.struct(F.lit(None).cast("long").alias("le"), F.col("all").alias("n")))
    return counts.select("content_type", F.explode(pairs).alias("b")).select("content_type", "b.le", "b.n")


def log_level(status: Column) -> Column:
    return F.when(status >= 500, "error").when(status >= 400, "warn").otherwise("info")


def fingerprint(key: Column) -> Column:
    return F.sha2(key, 256)


def pairing_payload(session_id: Column, fingerprint_hex: Column, code: Column) -> Column:
    return F.to_json(F.struct(session_id.alias("session_id"), fingerprint_hex.alias("fingerprint"), code.alias("code")))


def notification(bundle_id: Column, sender: Column) -> Column:
    return F.to_json(F.struct(F.lit("bundle").alias("type"), bundle_id.alias("bundle_id"), sender.alias("from")))
