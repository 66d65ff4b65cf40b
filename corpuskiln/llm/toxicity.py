"""Toxicity scores: FTRL-proximal logistic regression over hashed n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import buffer_of, groups, hashes, mix, spans

_U = np.uint64
WIDTH, SAMPLE, SHARD_ROWS, EPOCHS = 1 << 20, 16000, 8000, 3
ALPHA, BETA, L2 = 0.1, 1.0, 0.01
#: L1 strength for a full shard; the noise it must exceed grows with the root of the rows.
L1 = 30.0
#: Bytes that part words here: all of ASCII but letters and digits.
_PARTS = np.ones(256, bool)
_PARTS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _features(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Per text the hashed places of its words, word stems, word pairs and skip pairs; 0 is the bias."""
    data, offsets = buffer_of(texts)
    starts, ends, counts = spans(data, offsets, _PARTS)
    words = hashes(data, starts, ends)
    stems = [hashes(data, starts, np.minimum(ends, starts + k)) + _U(k) for k in (4, 5, 6)]
    left = mix(words + _U(11))
    kinds = [mix(words), *map(mix, stems)]
    far = np.cumsum(counts)
    pairs = [(k, mix(left[:-k] * _U(2 * k + 1) + words[k:])) for k in (1, 2, 3) if len(words) > k]
    for end, n in zip(far.tolist(), counts.tolist(), strict=True):
        own = [x[end - n : end] for x in kinds] + [x[end - n : end - k] for k, x in pairs if n > k]
        yield np.concatenate([x % _U(width - 1) for x in own]).astype(np.int64) + 1


def _train(width: int, l1: float, base: float):
    """Streams one shard's rows, in order, through FTRL; gives its non-zero weights and how much each was trained."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, n = np.zeros(width), np.zeros(width)
        for whole in batches:
            for batch in groups(whole, "text"):
                for places, y in zip(_features(batch.column("text"), width), batch.column("y").to_pylist(), strict=True):
                    at = np.append(np.unique(places), 0)
                    zs, ns = z[at], n[at]
                    free = l1 * (at > 0)
                    w = np.where(np.abs(zs) > free, (np.sign(zs) * free - zs) / ((BETA + np.sqrt(ns)) / ALPHA + L2), 0)
                    g = 1 / (1 + np.exp(-np.clip(base + w.sum(), -35, 35))) - y
                    z[at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
                    n[at] = ns + g * g
        free = np.where(np.arange(width) > 0, l1, 0.0)
        at = np.flatnonzero(np.abs(z) > free)
        w = (np.sign(z[at]) * free[at] - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w), pa.array(n[at])], ["place", "weight", "trained"])

    return run


def _score(places: np.ndarray, weights: np.ndarray, width: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(width)
        dense[places] = weights
        for whole in batches:
            for batch in groups(whole, "text"):
                out = []
                for at in _features(batch.column("text"), width):
                    at = np.unique(at[dense[at] != 0])
                    out.append(1 / (1 + np.exp(-np.clip(dense[0] + dense[at].sum(), -35, 35))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, name])

    return run


def usable(labels: DataFrame, held_out) -> DataFrame:
    """The labels (doc_id, y) that may be learnt from."""
    return labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out)


def dealt(documents: DataFrame, known: DataFrame, shards: int, epochs: int) -> DataFrame:
    """The known rows' texts, `epochs` times over, one partition and one order for each shard."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(known), "doc_id")
    shard = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).cast("int")
    rows = rows.withColumn("shard", shard).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    return rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("epoch", F.xxhash64("doc_id"), "doc_id", "text")


def fit(documents: DataFrame, labels: DataFrame, held_out, sample: int = SAMPLE, width: int = WIDTH, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of the model, at most `width` of them, learnt from rows outside `held_out`.

    At most `sample` labelled rows are learnt from, those with the smallest hash of doc_id. They are
    dealt to shards of about SHARD_ROWS, each a partition of its own; a task streams a shard's rows `epochs` times, in one order,
    through FTRL-proximal with per-coordinate rates, and the shards' weights are averaged by how much
    each shard trained the coordinate. The bias starts from the sample's share of toxic rows. Without labelled rows the
    model has no weights and every score is 0.5.
    """
    known = usable(labels, held_out).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    n, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    base = float(np.log((toxic + 1) / (n - toxic + 1)))
    shards = max(1, round(n / SHARD_ROWS))
    l1 = L1 * (n / shards / SHARD_ROWS) ** 0.5
    rows = dealt(documents, known, shards, epochs)
    parts = rows.select("text", "y").mapInArrow(_train(width, l1, base), "place long, weight double, trained double")
    mean = parts.groupBy("place").agg((F.sum(F.col("weight") * F.col("trained")) / F.sum("trained")).alias("weight"))
    model = mean.where("weight <> 0").toPandas()
    places, weights = model["place"].to_numpy(np.int64), model["weight"].to_numpy(np.float64)
    bias = base + weights[places == 0].sum()
    return np.append(places[places > 0], 0), np.append(weights[places > 0], bias)


def held_out_rows():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, names: tuple[str, str] = ("score", "predicted"), **options) -> DataFrame:
    """All columns of `documents` and score (0 to 1, higher: toxic likelier) and predicted (int).

    The model is learnt from `labels` on rows whose crc32(doc_id as text) mod 4 is not 2 (see fit), and
    sees nothing of a document but its whole text. A null or empty text gets the bias alone; so does
    every text where nothing could be learnt. A null doc_id is scored as any other. Repeated rows
    each get a score; repeated labels count once, toxic if any says so. Columns of `documents` named
    as `names` says the two new ones are, are replaced. Empty tables give empty results.
    """
    places, weights = fit(documents, labels, held_out_rows(), **options)
    width = options.get("width", WIDTH)
    rest = documents.drop(*names)
    schema = rest.withColumn(names[0], F.lit(0.0)).schema
    scored = rest.mapInArrow(_score(places, weights, width, names[0]), schema)
    return scored.withColumn(names[1], (F.col(names[0]) >= threshold).cast("int"))
