"""Indexing files and searching them, end to end."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import first_line, is_blank
from ..operators.chunking import OVERLAP, SIZE, chunks
from ..operators.embedding import Embedder, embedded
from ..operators.rerank import Reranker, reranked_if_possible
from ..operators.retrieval import RESULT, hybrid, located, nearest, of_types, with_threshold
from ..operators.store import Store
from ..sources.files import GONE, parted, read_paths


def index(spark: SparkSession, store: Store, paths: list[str] | DataFrame, embedder: Embedder, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Reads, cuts, embeds and stores files, as one change; returns the rejects (path, reason), which the store keeps too.

    paths is a list, or a DataFrame (path) of any length. An emptied or missing file loses its
    chunks, as does a path that has become a link; a file that can't be read, cut or embedded is a reject and keeps those it had.
    """
    if not isinstance(paths, DataFrame):
        if relative := [p for p in paths if not p.startswith("/") and ":/" not in p]:
            raise ValueError(f"not absolute: {relative}")
        paths = spark.createDataFrame([(p,) for p in paths], "path string")
    return index_read(store, read_paths(paths), embedder, size, overlap)


def index_read(store: Store, read: DataFrame, embedder: Embedder, size: int = SIZE, overlap: int = OVERLAP, gone: DataFrame | None = None, on_results: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Stores what read_paths gave, and removes what is gone (path) besides; returns the rejects. Files are opened once.

    on_results is called, when all is stored, with what became of every path: (path, result, reason), result indexed, rejected or removed.
    """
    read = read.persist(StorageLevel.DISK_ONLY)
    try:
        files, rejects = parted(read)
        left = rejects.where(F.col("reason").isin(GONE)).select("path")
        left = left if gone is None else left.unionByName(gone.select("path"))
        if read.isEmpty() and left.isEmpty():
            return rejects
        failed = index_files(store, files, embedder, size, overlap, rejects.where("reason <> 'link'"), left)
        if on_results:
            bad = failed.groupBy("path").agg(F.min("reason").alias("reason"))
            stored = files.select("path", F.lit("indexed").alias("result")).unionByName(left.distinct().withColumn("result", F.lit("removed")))
            results = stored.join(bad, "path", "full_outer")
            result = F.when(F.col("result") == "removed", "removed").when(F.col("reason").isNotNull(), "rejected").otherwise("indexed")
            on_results(results.select("path", result.alias("result"), "reason"))
        return failed
    finally:
        read.unpersist()


def index_files(
    store: Store, files: DataFrame, embedder: Embedder, size: int = SIZE, overlap: int = OVERLAP, rejects: DataFrame | None = None, gone: DataFrame | None = None,
) -> DataFrame:
    """files: path, text, file_type, last_modified, line_offset. Returns the files that failed (path, reason), with rejects among them."""
    cut = chunks(files.withColumn("key", F.xxhash64("path")), size, overlap, errors=True)
    meta = files.select("path", "file_type", "last_modified", F.lit(int(time.time())).cast("long").alias("last_indexed"))
    made = embedded(cut.select("path", "chunk_index", "start_line", "end_line", "content", "error"), embedder)
    return store.upsert(meta, made, rejects, gone).select("path", "reason")


def search(
    store: Store, embedder: Embedder, query: str, top_k: int = 5, filter_file_type: list[str] | None = None, use_hybrid: bool | None = None,
    threshold: float | None = None, reranker: Reranker | None = None, config: Config | None = None,
) -> DataFrame:
    """Results (chunk_id, file_path, start_line, end_line, content, score, score_kind), best first.

    score_kind says what score is: distance (smaller is better), rrf or rerank. A blank query has no
    results. use_hybrid and threshold, where they aren't given, are the settings' (config); a threshold outside 0 to 1
    is ignored. The lexical arm reads the store's postings of the query's words. The best top_k ids come to the driver, so that only their chunks
    are read. A reranker that fails leaves the results in their order.
    """
    if not 1 <= top_k <= 100:
        raise ValueError("Invalid top_k: must be between 1 and 100")
    config = config or Config()
    use_hybrid = config.hybrid_search if use_hybrid is None else use_hybrid
    threshold = config.relevance_threshold if threshold is None else threshold
    threshold = threshold if threshold is not None and 0 <= threshold <= 1 else None
    pieces, vectors, *said = store.tables("chunks", "vectors", "postings", "lengths")
    pieces = pieces.withColumnRenamed("path", "file_path")
    if not query.strip():
        return pieces.withColumn("score", F.lit(0.0)).withColumn("score_kind", F.lit("none")).select(*RESULT).limit(0)
    q = embedder.embed([query])[0].tolist()
    if use_hybrid:
        hits, kind = hybrid(vectors, None, q, query, top_k, threshold, index=tuple(said)), "rrf"
    else:
        hits, kind = with_threshold(nearest(vectors, q, top_k), threshold).withColumnRenamed("distance", "score"), "distance"
    best = hits.select("chunk_id", "score").collect()
    found = store.spark.createDataFrame(best, "chunk_id long, score double")
    some = pieces.where(F.col("chunk_id").isin([r.chunk_id for r in best]))
    results = of_types(located(found, some).withColumn("score_kind", F.lit(kind)).select(*RESULT), filter_file_type or [])
    ranked = reranked_if_possible(results, query, reranker) if reranker else None
    if ranked is not None:
        return ranked.withColumn("score_kind", F.lit("rerank")).orderBy(F.desc("score"), "chunk_id")
    return results.orderBy(F.asc("score") if kind == "distance" else F.desc("score"), "chunk_id")


def previews(results: DataFrame) -> DataFrame:
    return results.where(~is_blank(F.col("content"))).select("chunk_id", "file_path", "start_line", "end_line", F.format_string("%.4f", "score").alias("score"), first_line(F.col("content")).alias("preview"))


def remove(store: Store, paths: list[str]) -> None:
    store.remove(paths)


def reindex(spark: SparkSession, store: Store, embedder: Embedder, paths: list[str] | DataFrame | None = None) -> DataFrame:
    """Indexes the given files again, or all that the store knows, as one change."""
    return index(spark, store, store.table("files").select("path") if paths is None else paths, embedder)


def status(store: Store) -> dict[str, int]:
    return store.stats().first().asDict()
