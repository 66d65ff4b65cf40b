"""Benchmark decontamination: a prefix-filtered join of benchmark windows with whole documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop
from .words import buffer_of, groups, hashes, mix, spans

_U = np.uint64
WINDOW, SHINGLE = 10, 5
#: The filter that tasks hold: one bit for each of 2^26 hash values (8 MB), whatever the benchmark's size.
BITS = 26
#: Words are runs of these: ASCII letters and digits, and every byte of a character beyond ASCII.
_PARTS = np.ones(256, bool)
_PARTS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_WEIGHTS = mix(np.arange(1, 1 << 10).astype(_U)) | _U(1)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, in order, and each text's number of words."""
    data, offsets = buffer_of(texts)
    starts, ends, counts = spans(data, offsets, _PARTS)
    return hashes(data, starts, ends), counts


def _rolled(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of `size` words."""
    n = max(0, len(words) - size + 1)
    total = np.full(n, size, _U)
    for k in range(size if n else 0):
        total += words[k : k + n] * _WEIGHTS[k]
    return mix(total)


def _item_windows(window: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in groups(whole, "text", 1 << 20):
                words, counts = _words(batch.column("text"))
                ids, ends = batch.column("item_id").to_pylist(), np.cumsum(counts)
                for item, end, n in zip(ids, ends.tolist(), counts.tolist(), strict=True):
                    if not n:
                        continue
                    length = min(window, n)
                    size = min(shingle, length)
                    own = words[end - n : end]
                    each, at = _rolled(own, size), length - size + 1
                    lists = np.lib.stride_tricks.sliding_window_view(each, at).ravel()
                    named = _rolled(own, length)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(named), pa.string()), pa.array(named.view(np.int64)), pa.array(np.full(len(named), length, np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(lists.view(np.int64)), at).cast(pa.list_(pa.int64()))],
                        ["item_id", "window", "length", "shingles"],
                    )

    return run


def _bits(shingles: DataFrame) -> np.ndarray:
    """The filter of these shingles: at most 2^20 words of 64 bits reach the driver, however many shingles there are."""
    placed = shingles.select(F.shiftrightunsigned("shingle", 64 - BITS).alias("place"))
    some = placed.selectExpr("shiftright(place, 6) AS word", "shiftleft(1L, cast(place & 63 AS int)) AS bit")
    found = some.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(_U)


def _postings(bits, sizes: list[int]):
    """Per document its number of words and where shingles occur that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in groups(whole, "text"):
                words, counts = _words(batch.column("text"))
                ends = np.cumsum(counts)
                docs, places, found = [], [], []
                for size in sizes:
                    h = _rolled(words, size)
                    place = h >> _U(64 - BITS)
                    at = np.flatnonzero((bits.value[(place >> _U(6)).astype(np.int64)] >> (place & _U(63))) & _U(1))
                    doc = np.searchsorted(ends, at, "right")
                    inside = at + size <= ends[doc]
                    docs.append(doc[inside])
                    places.append((at - ends[doc] + counts[doc])[inside])
                    found.append(h[at[inside]].view(np.int64))
                doc = np.concatenate([*docs, np.zeros(0, np.int64)])
                order = np.argsort(doc, kind="stable")
                lists = pa.array(np.searchsorted(doc[order], np.arange(batch.num_rows + 1)).astype(np.int32))
                position = np.concatenate([*places, np.zeros(0, np.int64)])[order]
                shingle = np.concatenate([*found, np.zeros(0, np.int64)])[order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key + np.arange(batch.num_rows)), batch.column("doc_id"), pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(lists, pa.array(position)), pa.ListArray.from_arrays(lists, pa.array(shingle))],
                    ["key", "doc_id", "n_words", "positions", "shingles"],
                )
                key += batch.num_rows

    return run


def _occurrences(hits: DataFrame, windows: DataFrame, shingle: int) -> DataFrame:
    """Where whole windows occur: (key, window, start, length).

    hits: key, n_words, pos, shingle. A window's shingles are ordered by how often documents have them;
    the rarest is the prefix that an exact containment can't do without. It is joined with the hits; the
    window it stands for must lie within the document (length and position); and the
    shingles that cover the window must be at their places.
    """
    each = windows.select("window", "length", "shingles", F.posexplode("shingles").alias("offset", "shingle"))
    often = hits.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
    rarity = F.struct(F.coalesce("often", F.lit(0)).alias("often"), "offset", "shingle")
    rarest = each.join(often, "shingle", "left").groupBy("window").agg(F.min(rarity).alias("p"), F.first("length").alias("length"), F.first("shingles").alias("shingles"))
    size = F.least("length", F.lit(shingle))
    steps = F.array_distinct(F.concat(F.sequence(F.lit(0), F.col("length") - size, size), F.array(F.col("length") - size)))
    cover = F.transform(steps, lambda k: F.struct(k.alias("offset"), F.get("shingles", k).alias("shingle")))
    prefixes = rarest.where("p.often > 0").select("window", "length", F.col("p.offset").alias("offset"), F.col("p.shingle").alias("shingle"), cover.alias("cover"))
    start = (F.col("pos") - F.col("offset")).alias("start")
    near = hits.join(prefixes, "shingle").select("key", "n_words", "window", "length", start, "cover").where("start >= 0 and start + length <= n_words")
    need = near.select("key", "window", "start", "length", F.size("cover").alias("n_cover"), F.explode("cover").alias("c"))
    need = need.select("key", "window", "start", "length", "n_cover", (F.col("start") + F.col("c.offset")).alias("pos"), F.col("c.shingle").alias("shingle"))
    there = need.join(hits.select("key", "pos", "shingle"), ["key", "pos", "shingle"], "left_semi")
    return there.groupBy("key", "window", "start", "length").agg(F.count(F.lit(1)).alias("n"), F.first("n_cover").alias("n_cover")).where("n = n_cover").drop("n", "n_cover")


def _merged(occurrences: DataFrame) -> DataFrame:
    """Per document the hit words as spans (start, end) that neither meet nor overlap."""
    each = occurrences.groupBy("key", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    before = Window.partitionBy("key").orderBy("start")
    reached = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("new", (F.coalesce(reached, F.lit(-1)) < F.col("start")).cast("int"))
    each = each.withColumn("span", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    each = each.groupBy("key", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return each.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _items(occurrences: DataFrame, items: DataFrame) -> DataFrame:
    """Per document the items whose windows occur, looked up once for each distinct set of windows."""
    sets = occurrences.groupBy("key").agg(F.sort_array(F.collect_set("window")).alias("windows"))
    sets = sets.withColumn("named", F.sha2(F.array_join(F.col("windows").cast("array<string>"), ","), 256))
    each = sets.groupBy("named").agg(F.first("windows").alias("windows")).select("named", F.explode("windows").alias("window"))
    listed = each.join(items, "window").groupBy("named").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return sets.select("key", "named").join(listed, "named").select("key", "items")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Which words of documents (doc_id, text) lie inside occurrences of windows of benchmark items (item_id, text).

    Returns per document doc_id, n_words, spans (array of start and end in words) of the hit words, and items, the sorted ids
    (as strings) of the items with a window in it. A window is `window` consecutive words of an item, or a shorter
    item's words. Words are runs of ASCII letters (lower-cased) and digits and of characters beyond ASCII.

    A window is a set of shingles of `shingle` words with their places. Distinct windows only are joined, by their rarest shingle (counts over all
    documents), then checked against position, length and the shingles that cover them. Documents are read
    once; what leaves that pass is their number of words and the shingles that pass a filter of fixed size.
    The filter only saves work: a join decides. Words are 64-bit hashes: a wrong word
    in a window counts as right with a chance of 2^-64.

    A null or empty text has no words, no spans, no items; an item without words has no window. Every row of
    documents gives a row, also repeated ones and those with a null doc_id. Rows with the same item_id are one
    item; an item with a null id gives spans and isn't listed. Columns other than these aren't
    read. With an empty benchmark nothing is hit; without documents the result is empty.
    """
    if not 1 <= shingle <= window < len(_WEIGHTS):
        raise ValueError(f"shingles of {shingle} words in windows of {window}")
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    given = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    given = cut(given.mapInArrow(_item_windows(window, shingle), "item_id string, window long, length int, shingles array<long>"), "windows")
    windows = given.groupBy("window").agg(F.first("length").alias("length"), F.first("shingles").alias("shingles"))
    sizes = sorted(r[0] for r in given.select(F.least("length", F.lit(shingle))).distinct().collect())
    bits = spark.sparkContext.broadcast(_bits(windows.select(F.explode("shingles").alias("shingle"))))
    schema = "key long, doc_id long, n_words long, positions array<long>, shingles array<long>"
    postings = cut(docs.mapInArrow(_postings(bits, sizes), schema), "postings")
    pairs = postings.where("size(shingles) > 0").select("key", "n_words", F.explode(F.arrays_zip("positions", "shingles")).alias("p"))
    hits = pairs.select("key", "n_words", F.col("p.positions").alias("pos"), F.col("p.shingles").alias("shingle"))
    occurrences = cut(_occurrences(hits, windows, shingle), "occurrences")
    bits.destroy()
    items = cut(given.where("item_id is not null").select("window", "item_id").distinct(), "items")
    drop(given)
    out = postings.select("key", "doc_id", "n_words").join(_merged(occurrences), "key", "left").join(_items(occurrences, items), "key", "left")
    spans_of, items_of = F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", spans_of.alias("spans"), items_of.alias("items"))
