"""Vector, lexical and hybrid search over chunk, vector and posting tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamp, extension, vector_similarity, words

#: Fixed values of the ranking formulas.
K1, B, LEAST_IDF, RRF = 1.2, 0.75, 1e-6, 60.0
RESULT = ["chunk_id", "file_path", "start_line", "end_line", "content", "score", "score_kind"]


def nearest(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k rows of vectors (chunk_id, embedding) nearest to query: chunk_id and distance (L2, double).

    Ties go to the smaller chunk_id. Each task keeps its own k best; only those are sorted together.
    Rows whose vector is null or of another length take no part, nor do null components' rows.
    """
    q = np.asarray(query, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, best = np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            distance = np.sqrt(((flat.reshape(-1, len(q)) - q) ** 2).sum(1))
            ids, best = np.append(ids, batch.column("chunk_id").to_numpy()), np.append(best, distance)
            first = np.lexsort((ids, best))[:k]
            ids, best = ids[first], best[first]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(best)], ["chunk_id", "distance"])

    sound = vectors.where(F.col("chunk_id").isNotNull() & (F.size("embedding") == len(q)) & ~F.exists("embedding", lambda x: x.isNull()))
    local = sound.select(F.col("chunk_id").cast("long"), "embedding").mapInArrow(run, "chunk_id long, distance double")
    return local.orderBy("distance", "chunk_id").limit(k)


def located(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """At most k hits with what chunks (chunk_id, file_path, start_line, end_line, content) say of them.

    The join comes after the limit: a hit without a chunk is lost and isn't replaced.
    """
    return hits.join(chunks.select("chunk_id", "file_path", "start_line", "end_line", "content"), "chunk_id")


def with_threshold(hits: DataFrame, threshold: float | None) -> DataFrame:
    """Hits whose similarity reaches the threshold; applied to the k nearest, so fewer may be left."""
    return hits if threshold is None else hits.where(vector_similarity(F.col("distance")) >= threshold)


_WORDS = re.compile(r"[^\W_]+")


#: So many words' postings are put in the order of their terms at once.
_SORTED_WORDS = 1 << 19


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (term, chunk_id, tf, positions) of chunks (chunk_id, content), in runs that are sorted by term."""
    ids: list[int] = []
    terms: list[str] = []
    sizes: list[int] = []
    positions: list[int] = []

    def written() -> pa.RecordBatch:
        tf = np.array(sizes, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tf)).astype(np.int32)), pa.array(np.array(positions, np.int32)))
        named = pa.array(terms, pa.string()).dictionary_encode()
        rank = np.empty(len(named.dictionary), np.int32)
        rank[pc.sort_indices(named.dictionary).to_numpy()] = np.arange(len(rank), dtype=np.int32)
        out = pa.RecordBatch.from_arrays([named.cast(pa.string()), pa.array(ids, pa.int64()), pa.array(tf), lists], ["term", "chunk_id", "tf", "positions"])
        out = out.take(pa.array(np.argsort(rank[named.indices.to_numpy()], kind="stable")))
        for column in (ids, terms, sizes, positions):
            column.clear()
        return out

    for batch in batches:
        for chunk, content in zip(batch.column("chunk_id").to_pylist(), batch.column("content"), strict=True):
            held: dict[str, list[int]] = {}
            for at, word in enumerate(_WORDS.findall((content.as_py() or "").lower())):
                held.setdefault(word, []).append(at)
            ids += [chunk] * len(held)
            terms += held
            for places in held.values():
                sizes.append(len(places))
                positions += places
            if len(positions) > _SORTED_WORDS:
                yield written()
    if ids:
        yield written()


def postings(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index tables of chunks (chunk_id, content): (term, chunk_id, tf, positions) and (chunk_id, length).

    A chunk's words are counted within its row, so nothing is shuffled; a task's postings come in runs sorted by term, so that a file's pages
    hold few terms each. Positions count words from 0.
    """
    terms = chunks.select(F.col("chunk_id").cast("long"), "content").mapInArrow(_placed, "term string, chunk_id long, tf long, positions array<int>")
    return terms, chunks.select("chunk_id", F.size(words(F.coalesce("content", F.lit("")))).cast("long").alias("length"))


def scored(hits: DataFrame, totals: DataFrame, terms: int) -> DataFrame:
    """BM25 of rows (chunk_id, length, tf0, tf1, ...) given one row (n, mean, df0, df1, ...)."""

    def part(i: int) -> Column:
        df, tf, n = F.col(f"df{i}").cast("double"), F.col(f"tf{i}").cast("double"), F.col("n").cast("double")
        idf = F.log((n - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))

    return hits.join(F.broadcast(totals)).select("chunk_id", sum((part(i) for i in range(1, terms)), part(0)).alias("bm25"))


def _distinct(query: str) -> list[str]:
    return list(dict.fromkeys(w for w in re.split(r"[\W_]+", query.lower()) if w))


def lexical(chunks: DataFrame, query: str, k: int) -> DataFrame:
    """The k chunks with the largest BM25 among those that hold all of the query's words.

    chunk_id and bm25, ties to the smaller chunk_id; a blank query has none. All chunks are read and split into
    words once; what is shuffled is a few numbers for each chunk.
    """
    terms = _distinct(query)
    if not terms:
        return chunks.select("chunk_id", F.lit(0.0).alias("bm25")).limit(0)
    split = chunks.select("chunk_id", F.split(F.lower(F.coalesce("content", F.lit(""))), r"[^\p{L}\p{N}]+").alias("w"))
    size = lambda w: F.size(w).cast("long")
    # Between separators the list has an empty word at most at either end.
    counted = [(size("w") - size(F.array_remove("w", t))).alias(f"tf{i}") for i, t in enumerate(terms)]
    held = split.select("chunk_id", size(F.array_remove("w", "")).alias("length"), *counted)
    # Both uses below read one shuffle of a few numbers for each chunk, so texts are split once.
    held = held.repartition("chunk_id")
    totals = held.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))])
    every = held.where(" AND ".join(f"tf{i} > 0" for i in range(len(terms))))
    return scored(every, totals, len(terms)).orderBy(F.desc("bm25"), "chunk_id").limit(k)


def lexical_indexed(terms_table: DataFrame, lengths: DataFrame, query: str, k: int) -> DataFrame:
    """As lexical, from the index tables: only the query's words' postings are read."""
    terms = _distinct(query)
    if not terms:
        return lengths.select("chunk_id", F.lit(0.0).alias("bm25")).limit(0)
    own = terms_table.where(F.col("term").isin(terms)).groupBy("chunk_id").agg(*[F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(terms)])
    df = own.agg(*[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))])
    totals = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).join(F.broadcast(df))
    every = own.where(" AND ".join(f"tf{i} > 0" for i in range(len(terms))))
    return scored(every.join(lengths, "chunk_id"), totals, len(terms)).orderBy(F.desc("bm25"), "chunk_id").limit(k)


def fused(vector_hits: DataFrame, lexical_hits: DataFrame) -> DataFrame:
    """Reciprocal ranks of both arms added up: chunk_id, rrf, distance and bm25 (null where not found)."""
    share = lambda order: 1 / (F.lit(RRF) + F.row_number().over(Window.orderBy(*order)))
    left = vector_hits.select("chunk_id", "distance", share(["distance", "chunk_id"]).alias("a"))
    right = lexical_hits.select("chunk_id", "bm25", share([F.desc("bm25"), "chunk_id"]).alias("b"))
    both = left.join(right, "chunk_id", "full_outer")
    return both.select("chunk_id", (F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias("rrf"), "distance", "bm25")


def hybrid(
    vectors: DataFrame, chunks: DataFrame | None, query: list[float], text: str, k: int, threshold: float | None = None, compat: bool = False,
    index: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Rows (chunk_id, score): both arms' max(2k, 10) best, fused; the best score is 1.

    The lexical arm reads index (postings and lengths) if it is given, else the chunks.

    The threshold is one on the vector arm's similarity, before fusing. compat applies it to fused
    rows instead, taking what the arm that found a row first calls its score for a distance, which for
    a lexical hit is its negative BM25.
    """
    wide = max(2 * k, 10)
    near = nearest(vectors, query, wide)
    said = lexical_indexed(*index, text, wide) if index else lexical(chunks, text, wide)
    rows = fused(near if compat else with_threshold(near, threshold), said)
    if compat and threshold is not None:
        rows = rows.where(clamp(1 - F.pow(F.coalesce("distance", -F.col("bm25")), 2) / 2) >= threshold)
    best = rows.orderBy(F.desc("rrf"), "chunk_id").limit(k)
    return best.select("chunk_id", (F.col("rrf") / F.max("rrf").over(Window.partitionBy())).alias("score"))


def of_types(results: DataFrame, types: list[str]) -> DataFrame:
    """Results whose file's extension is one of `types`, in any case; no types, no filter."""
    return results.where(F.lower(extension(F.col("file_path"))).isin([t.lower() for t in types])) if types else results


def tool_arguments(args: Column) -> dict[str, Column]:
    """What a search call's JSON arguments come to: top_k, threshold and error."""
    k = F.get_json_object(args, "$.top_k")
    whole = F.when(k.rlike(r"^[0-9]{1,18}$"), k.cast("long"))
    top_k = F.coalesce(whole, F.lit(5).cast("long"))
    threshold = F.get_json_object(args, "$.threshold").try_cast("double")
    error = F.when(F.get_json_object(args, "$.query").isNull(), "Missing required parameter: query").when(~top_k.between(1, 100), "Invalid top_k: must be between 1 and 100")
    return {"top_k": top_k, "threshold": F.when(threshold.between(0, 1), threshold), "error": error}
