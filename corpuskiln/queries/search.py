"""Vector, lexical and hybrid search over documents and embeddings."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import base64url, base64url_decoded, iso8601, is_blank, is_url, listed, path_tail, pretty_json, rpc_error, short_code, vector_similarity
from ..operators import embedding, relay, rerank, retrieval, store
from ..operators.embedding import HashEmbedder
from ..operators.matching import Near, Phrase, Prefix, matched
from ..plans.search import index_files, previews, search
from ..session import shared_dir
from ..sources.files import chunker_of, language_of
from ..sources.tables import table
from . import query

TEXT, K, THRESHOLD = "the with", 10, 0.31

_V = "v AS (SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE chunk_id = 0)"
_DIST = f"{_V}, dist AS (SELECT chunk_id, list_distance(e, q) AS distance FROM v, q)"
_FILE = "'/data/' || source || '/' || doc_id || '.' || lang"
_CHUNKS = f"chunks AS (SELECT doc_id AS chunk_id, {_FILE} AS file_path, 1 AS start_line, len(string_split(text, chr(10))) AS end_line, text AS content FROM documents)"


def _near(n: int, name: str = "near") -> str:
    return f"{name} AS (SELECT * FROM dist ORDER BY distance, chunk_id LIMIT {n})"


def _bm25(n: int) -> str:
    words = TEXT.split()
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(words))
    df = ", ".join(f"count(CASE WHEN tf{i} > 0 THEN 1 END) AS df{i}" for i in range(len(words)))
    idf = "CASE WHEN ln((n - df{0} + 0.5) / (df{0} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{0} + 0.5) / (df{0} + 0.5)) END"
    part = " + ".join(f"({idf.format(i)}) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(len(words)))
    return (
        "w AS (SELECT chunk_id, list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM chunks),"
        f" h AS (SELECT chunk_id, len(w) AS length, {tf} FROM w), t AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(length) AS mean, {df} FROM h),"
        f" lex AS (SELECT chunk_id, {part} AS bm25 FROM h, t WHERE {' AND '.join(f'tf{i} > 0' for i in range(len(words)))} ORDER BY bm25 DESC, chunk_id LIMIT {n})"
    )


def _fused(near: str) -> str:
    return (
        f"a AS (SELECT chunk_id, distance, 1 / (60 + row_number() OVER (ORDER BY distance, chunk_id))::DOUBLE AS a FROM {near}),"
        " b AS (SELECT chunk_id, bm25, 1 / (60 + row_number() OVER (ORDER BY bm25 DESC, chunk_id))::DOUBLE AS b FROM lex),"
        " fused AS (SELECT coalesce(a.chunk_id, b.chunk_id) AS chunk_id, coalesce(a, 0) + coalesce(b, 0) AS rrf, distance, bm25 FROM a FULL JOIN b ON a.chunk_id = b.chunk_id)"
    )


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float], DataFrame]:
    """Vectors, the query vector (that of chunk 0) and chunks."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    first = vectors.where("chunk_id = 0").select(V.doubles(F.col("embedding")).alias("e")).first()
    path = F.concat(F.lit("/data/"), "source", F.lit("/"), "doc_id", F.lit("."), "lang")
    chunks = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), path.alias("file_path"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"), F.col("text").alias("content")
    )
    return vectors, first["e"] if first else [0.0], chunks


def _shown(results: DataFrame) -> DataFrame:
    return results.select("chunk_id", "file_path", "start_line", "end_line", F.md5("content").alias("content"), F.round("score", 6).alias("score"))


_SHOW = "chunk_id, file_path, start_line, end_line, md5(content) AS content, round(score, 6) AS score"


@query(f"WITH {_DIST}, {_near(K)}, {_CHUNKS} SELECT {_SHOW.replace('score, 6', 'distance, 6')} FROM near JOIN chunks USING (chunk_id)")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, q, chunks = _parts(spark, sf_dir)
    return _shown(retrieval.located(retrieval.nearest(vectors, q, K), chunks).withColumnRenamed("distance", "score"))


@query(f"WITH {_DIST}, {_near(50)} SELECT chunk_id, round(distance, 6) AS distance FROM near WHERE greatest(0, least(1, 1 - distance * distance / 2)) >= {THRESHOLD}")
def vector_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, q, _ = _parts(spark, sf_dir)
    return retrieval.with_threshold(retrieval.nearest(vectors, q, 50), THRESHOLD).select("chunk_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_DIST} SELECT chunk_id, round(greatest(0, least(1, 1 - distance * distance / 2)), 6) AS similarity FROM dist")
def vector_similarity_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, q, _ = _parts(spark, sf_dir)
    away = F.zip_with(V.doubles(F.col("embedding")), F.array(*map(F.lit, q)), lambda x, y: x - y)
    return vectors.select("chunk_id", F.round(vector_similarity(V.norm(away)), 6).alias("similarity"))


@query(f"WITH {_CHUNKS}, {_bm25(50)} SELECT chunk_id, round(bm25, 6) AS bm25 FROM lex")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.lexical(_parts(spark, sf_dir)[2], TEXT, 50).select("chunk_id", F.round("bm25", 6).alias("bm25"))


@query(f"WITH {_CHUNKS}, {_bm25(50)} SELECT chunk_id, round(bm25, 6) AS bm25 FROM lex")
def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, lengths = retrieval.postings(_parts(spark, sf_dir)[2])
    return retrieval.lexical_indexed(terms, lengths, TEXT, 50).select("chunk_id", F.round("bm25", 6).alias("bm25"))


_PLACES = """p AS (SELECT doc_id AS chunk_id, i, w[i] AS term FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM
  (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents))),
phrase AS (SELECT a.chunk_id, count(*) AS n FROM p a JOIN p b ON a.chunk_id = b.chunk_id AND b.i = a.i + 1 AND a.term = 'on' AND b.term = 'the' GROUP BY 1),
near AS (SELECT x.chunk_id, count(*) AS n FROM p x WHERE x.term IN ('with', 'is') AND EXISTS (SELECT 1 FROM p y WHERE y.chunk_id = x.chunk_id AND y.term IN ('with', 'is') AND y.term <> x.term AND y.i BETWEEN x.i AND x.i + 6) GROUP BY 1),
prefix AS (SELECT chunk_id, count(*) AS n FROM p WHERE term LIKE 'ther%' GROUP BY 1),
banned AS (SELECT chunk_id FROM p WHERE term = 'das')"""


@query(f"""
WITH {_PLACES}, f AS (SELECT chunk_id, phrase.n AS tf0, coalesce(near.n, 0) + coalesce(prefix.n, 0) AS tf1 FROM phrase LEFT JOIN near USING (chunk_id) LEFT JOIN prefix USING (chunk_id))
SELECT chunk_id, tf0, tf1 FROM f WHERE tf1 > 0 AND chunk_id NOT IN (SELECT chunk_id FROM banned)""")
def fts_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase, and words near each other or a prefix, and not a word; by positional postings."""
    terms, _ = retrieval.postings(_parts(spark, sf_dir)[2])
    wanted = [Phrase("on the"), [Near("with is", 5), Prefix("ther")]]
    return matched(terms, wanted, [Phrase("das")])


@query(f"WITH {_DIST}, {_near(20)}, {_CHUNKS}, {_bm25(20)}, {_fused('near')} SELECT chunk_id, round(rrf, 6) AS rrf FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, q, chunks = _parts(spark, sf_dir)
    return retrieval.fused(retrieval.nearest(vectors, q, 20), retrieval.lexical(chunks, TEXT, 20)).select("chunk_id", F.round("rrf", 6).alias("rrf"))


_BEST = f"best AS (SELECT * FROM kept ORDER BY rrf DESC, chunk_id LIMIT {K}), scored AS (SELECT chunk_id, rrf / max(rrf) OVER () AS score FROM best)"
_AND_SHOW = f"SELECT {_SHOW} FROM scored JOIN chunks USING (chunk_id)"


@query(
    f"WITH {_DIST}, {_near(20, 'near20')}, near AS (SELECT * FROM near20 WHERE greatest(0, least(1, 1 - distance * distance / 2)) >= {THRESHOLD}),"
    f" {_CHUNKS}, {_bm25(20)}, {_fused('near')}, kept AS (SELECT * FROM fused), {_BEST} {_AND_SHOW}"
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, q, chunks = _parts(spark, sf_dir)
    return _shown(retrieval.located(retrieval.hybrid(vectors, chunks, q, TEXT, K, THRESHOLD), chunks))


@query(
    f"WITH {_DIST}, {_near(20)}, {_CHUNKS}, {_bm25(20)}, {_fused('near')},"
    f" kept AS (SELECT * FROM fused WHERE greatest(0, least(1, 1 - pow(coalesce(distance, -bm25), 2) / 2)) >= {THRESHOLD}), {_BEST} {_AND_SHOW}"
)
def hybrid_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, q, chunks = _parts(spark, sf_dir)
    return _shown(retrieval.located(retrieval.hybrid(vectors, chunks, q, TEXT, K, THRESHOLD, compat=True), chunks))


@query(f"WITH {_DIST}, {_near(50)}, {_CHUNKS} SELECT chunk_id, file_path, round(distance, 6) AS score FROM near JOIN chunks USING (chunk_id) WHERE lang IN ('en', 'de')".replace("WHERE lang IN", "WHERE lower(regexp_extract(file_path, '[^/]\\.([^./]+)$', 1)) IN"))
def filetype_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, q, chunks = _parts(spark, sf_dir)
    hits = retrieval.located(retrieval.nearest(vectors, q, 50), chunks)
    return retrieval.of_types(hits, ["EN", "de"]).select("chunk_id", "file_path", F.round("distance", 6).alias("score"))


_ARGS = "'{' || CASE WHEN event_id % 11 = 0 THEN '' ELSE '\"query\": \"q\", ' END || '\"top_k\": ' || CASE WHEN event_id % 7 = 0 THEN '\"x\"' ELSE json_extract_string(props, '$.k') END || ', \"threshold\": ' || (value / 300) || '}'"


@query(f"""
WITH a AS (SELECT event_id, value, {_ARGS} AS args FROM events),
b AS (SELECT event_id, value, json_extract_string(args, '$.query') AS q, coalesce(try_cast(json_extract_string(args, '$.top_k') AS BIGINT), 5) AS top_k FROM a)
SELECT event_id, top_k, CASE WHEN value / 300 <= 1 THEN round(value / 300, 6) END AS threshold,
  CASE WHEN q IS NULL THEN 'Missing required parameter: query' WHEN top_k NOT BETWEEN 1 AND 100 THEN 'Invalid top_k: must be between 1 and 100' END AS error FROM b""")
def tool_args_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.when(F.col("event_id") % 7 == 0, '"x"').otherwise(F.get_json_object("props", "$.k"))
    args = F.concat(F.lit("{"), F.when(F.col("event_id") % 11 == 0, "").otherwise('"query": "q", '), F.lit('"top_k": '), k, F.lit(', "threshold": '), (F.col("value") / 300).cast("string"), F.lit("}"))
    got = retrieval.tool_arguments(F.col("args"))
    return table(spark, sf_dir, "events").withColumn("args", args).select("event_id", got["top_k"].alias("top_k"), F.round(got["threshold"], 6).alias("threshold"), got["error"].alias("error"))


@query(f"WITH {_CHUNKS} SELECT chunk_id, start_line, end_line, printf('%.4f', chunk_id / 7) AS score, string_split(content, chr(10))[1] AS preview, CASE WHEN length(file_path) > 12 THEN '…' || right(file_path, 11) ELSE file_path END AS shown FROM chunks WHERE trim(content) <> ''")
def search_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _parts(spark, sf_dir)[2].withColumn("score", F.col("chunk_id") / 7)
    return previews(results).select("chunk_id", "start_line", "end_line", "score", "preview", path_tail(F.col("file_path"), 12).alias("shown"))


@query("""
WITH m AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id, CAST(pos % 8 AS INTEGER) AS dim, round(coalesce(avg(CASE WHEN (vec_id + pos // 8) % 3 <> 0 AND vec_id % 11 <> 0 THEN x END), 0), 6) + 0.0 AS value FROM m GROUP BY vec_id, pos % 8""")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as eight tokens of eight numbers, pooled over the tokens that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            hidden = batch.column("embedding").flatten().to_numpy().astype(np.float64).reshape(len(ids), 8, 8)
            mask = ((ids[:, None] + np.arange(8)) % 3 != 0) & (ids[:, None] % 11 != 0)
            pooled = embedding.mean_pool(hidden, mask)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(list(pooled), pa.list_(pa.float64()))], ["vec_id", "pooled"])

    pooled = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long, pooled array<double>")
    return pooled.select("vec_id", F.posexplode("pooled").alias("dim", "value")).select("vec_id", "dim", (F.round("value", 6) + 0.0).alias("value"))


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 5)) AS e FROM embeddings), n AS (SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v) SELECT vec_id, round(norm, 6) AS norm, round(CASE WHEN norm > 0 THEN e[1] / norm ELSE e[1] END, 6) + 0.0 AS first FROM n")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform(V.doubles(F.col("embedding")), lambda x: x * (F.col("vec_id") % 5))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", scaled.alias("e"))
    return rows.select("vec_id", F.round(V.norm(F.col("e")), 6).alias("norm"), (F.round(V.normalised(F.col("e"))[0], 6) + 0.0).alias("first"))


@query("WITH r AS (SELECT vec_id, label, 10 * embedding[1]::DOUBLE AS raw FROM embeddings), m AS (SELECT label, max(raw) > 1 OR min(raw) < 0 AS logits FROM r GROUP BY label) SELECT vec_id, round(CASE WHEN logits THEN 1 / (1 + exp(-raw)) ELSE greatest(0, least(1, raw)) END, 6) AS score FROM r JOIN m USING (label)")
def rerank_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "embeddings").select("vec_id", "label", (10 * F.col("embedding")[0].cast("double")).alias("raw"))
    models = raw.groupBy("label").agg(((F.max("raw") > 1) | (F.min("raw") < 0)).alias("logits"))
    return raw.join(models, "label").select("vec_id", F.round(rerank.as_probability(F.col("raw"), F.col("logits")), 6).alias("score"))


_ASKED = "the and of was with"


@query(f"""
WITH {_DIST}, {_near(50)}, {_CHUNKS}, r AS (SELECT chunk_id, len(list_intersect(string_split('{_ASKED}', ' '),
  regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'))) / 5.0::DOUBLE AS score FROM near JOIN chunks USING (chunk_id))
SELECT chunk_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, chunk_id) AS place FROM r""")
def rerank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, q, chunks = _parts(spark, sf_dir)
    ranked = rerank.reranked(retrieval.located(retrieval.nearest(vectors, q, 50), chunks), _ASKED, rerank.Overlap())
    place = F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")).cast("long")
    return ranked.select("chunk_id", F.round("score", 6).alias("score"), place.alias("place"))


def _stored(spark: SparkSession, sf_dir: str, files: DataFrame, into: store.Store | None = None) -> store.Store:
    """A store of files (doc_id, path, n_chars, text) that have an embedding: one chunk for each."""
    into = into or store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", 64)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    chunks = files.join(vectors, "doc_id").repartition("path").select(
        F.col("doc_id").alias("chunk_id"), "path", F.lit(0).alias("chunk_index"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"), F.col("text").alias("content"), "embedding"
    )
    into.upsert(files.select("path", F.lit("txt").alias("file_type"), F.col("n_chars").alias("last_modified"), F.lit(0).cast("long").alias("last_indexed")), chunks)
    return into


@query(f"""
WITH f AS (SELECT doc_id, {_FILE} AS path, n_chars FROM documents), new AS (SELECT path, n_chars + 1 AS n_chars FROM f WHERE doc_id % 10 = 3
  UNION ALL SELECT '/new' || path, n_chars FROM f WHERE doc_id % 50 = 1)
SELECT path, n_chars FROM f WHERE path NOT IN (SELECT path FROM new) UNION ALL SELECT * FROM new""")
def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files are stored; then some are stored again with other values, and new ones beside them."""
    files = _files(spark, sf_dir)
    kept = _stored(spark, sf_dir, files)
    changed = files.where("doc_id % 10 = 3").withColumn("n_chars", F.col("n_chars") + 1)
    added = files.where("doc_id % 50 = 1").withColumns({"doc_id": F.col("doc_id") + 1_000_000_000, "path": F.concat(F.lit("/new"), "path")})
    return _stored(spark, sf_dir, changed.unionByName(added), kept).table("files").select("path", F.col("last_modified").alias("n_chars"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/data/"), "source", F.lit("/"), "doc_id", F.lit("."), "lang")
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "source", "n_chars", "text")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src3')")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _files(spark, sf_dir).where("source = 'src3'").select(F.col("doc_id").alias("vec_id"))
    return store.removed(table(spark, sf_dir, "embeddings").select("vec_id", "label"), gone, "vec_id")


@query("SELECT (SELECT count(*) FROM documents WHERE source <> 'src3') AS files, (SELECT count(*) FROM documents JOIN embeddings ON doc_id = vec_id WHERE source <> 'src3') AS chunks")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a store that all files were put in and some were removed from."""
    kept = _stored(spark, sf_dir, _files(spark, sf_dir))
    kept.remove(_files(spark, sf_dir).where("source = 'src3'").select("path"))
    return kept.stats()


@query("SELECT count(*) AS vectors, count(CASE WHEN len(embedding) = 64 THEN 1 END) AS sound FROM embeddings")
def dim_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    sound = V.has_dimension(F.col("embedding"), 64)
    return store.with_dimension(table(spark, sf_dir, "embeddings"), 64).agg(F.count(F.lit(1)).alias("vectors"), F.count(F.when(sound, 1)).alias("sound"))


_EXT = "lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1))"


@query(f"""
WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || '/f' || page_id || '.' || (['md', 'RS', 'py', 'tsx', 'txt', 'go', 'h'])[1 + page_id % 7] AS path FROM pages)
SELECT page_id, path, {_EXT} AS ext, CASE WHEN {_EXT} = 'md' THEN 'markdown' WHEN {_EXT} IN ('rs', 'py', 'ts', 'js', 'go', 'java', 'c', 'cpp', 'h', 'hpp') THEN 'code' ELSE 'fallback' END AS chunker,
  CASE regexp_extract(path, '[^/]\\.([^./]+)$', 1) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'tsx' THEN 'javascript' WHEN 'go' THEN 'go' END AS language FROM p""")
def route_by_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import extension

    kinds = F.array(*map(F.lit, ["md", "RS", "py", "tsx", "txt", "go", "h"]))
    path = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/f"), "page_id", F.lit("."), F.element_at(kinds, (1 + F.col("page_id") % 7).cast("int")))
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    p = F.col("path")
    return rows.select("page_id", "path", F.lower(extension(p)).alias("ext"), chunker_of(p).alias("chunker"), language_of(p).alias("language"))


@query("SELECT event_id, strftime(make_timestamp(greatest(epoch(date_trunc('second', ts))::BIGINT - 1704500000, 0) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def iso8601_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", iso8601(F.unix_seconds(F.col("ts")) - 1704500000).alias("at"))


@query("SELECT doc_id, sha256(text) AS hash, octet_length(encode(text)) AS bytes, true AS same FROM documents")
def base64url_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode("text", "UTF-8")
    back = base64url_decoded(base64url(data))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(back, 256).alias("hash"), F.octet_length(back).cast("long").alias("bytes"), (back == data).alias("same"))


@query("SELECT event_id, list_aggregate(list_filter(list_transform(string_split(' ' || event_type || ' , ,' || user_id || ',', ','), lambda x: trim(x)), lambda x: x <> ''), 'string_agg', '|') AS listed FROM events")
def csv_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(" "), "event_type", F.lit(" , ,"), F.col("user_id").cast("string"), F.lit(","))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(listed(text), "|").alias("listed"))


@query("SELECT event_id, '{\"type\":\"bundle\",\"bundle_id\":\"' || event_id || '\",\"from\":\"' || user_id || '\"}' AS message, lpad((event_id * 7919 % 1000000 // 1000)::VARCHAR, 3, '0') || '-' || lpad((event_id * 7919 % 1000)::VARCHAR, 3, '0') AS code FROM events")
def notify_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = relay.notification(F.col("event_id").cast("string"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", note.alias("message"), short_code(F.col("event_id") * 7919).alias("code"))


@query("SELECT page_id, starts_with(url, 'http://') OR starts_with(url, 'https://') AS is_url, trim(html) = '' AS blank FROM pages")
def url_and_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", is_url(F.col("url")).alias("is_url"), is_blank(F.col("html")).alias("blank"))


_METHOD = "(['initialize', 'tools/list', 'tools/call', 'bad', 'initialized'])[1 + event_id % 5]"
_RPC = f"""'{{"jsonrpc": "' || CASE WHEN event_id % 13 = 0 THEN '1.0' ELSE '2.0' END || '", "method": "' || {_METHOD} || '"' || CASE WHEN event_id % 3 = 0 THEN '' ELSE ', "id": 1' END || CASE WHEN event_id % 2 = 0 THEN ', "params": {{"name": "search"}}' ELSE '' END || '}}'"""


@query(f"""
WITH r AS (SELECT event_id, {_RPC} AS body FROM events)
SELECT event_id, CASE WHEN json_extract_string(body, '$.id') IS NULL THEN 0 WHEN json_extract_string(body, '$.jsonrpc') <> '2.0' THEN -32600
  WHEN json_extract_string(body, '$.method') NOT IN ('initialize', 'initialized', 'tools/call', 'tools/list') THEN -32601
  WHEN json_extract_string(body, '$.method') = 'tools/call' AND json_extract_string(body, '$.params.name') IS NULL THEN -32602 ELSE 0 END AS error FROM r""")
def rpc_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    method = F.element_at(F.array(*map(F.lit, ["initialize", "tools/list", "tools/call", "bad", "initialized"])), (1 + e % 5).cast("int"))
    body = F.concat(
        F.lit('{"jsonrpc": "'), F.when(e % 13 == 0, "1.0").otherwise("2.0"), F.lit('", "method": "'), method, F.lit('"'),
        F.when(e % 3 == 0, "").otherwise(', "id": 1'), F.when(e % 2 == 0, ', "params": {"name": "search"}').otherwise(""), F.lit("}"),
    )
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(rpc_error(body), F.lit(0)).alias("error"))


@query("""
SELECT doc_id // 10 AS page, '[' || chr(10) || string_agg('  {' || chr(10) || '    "doc_id": ' || doc_id || ',' || chr(10) || '    "lang": ' || to_json(lang) || ',' || chr(10)
  || '    "text": ' || coalesce(to_json(text)::VARCHAR, 'null') || chr(10) || '  }', ',' || chr(10) ORDER BY doc_id) || chr(10) || ']' AS text FROM documents GROUP BY 1""")
def tool_result_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, ten to a page, as the texts of a tool's results."""
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") - F.col("doc_id") % 10).alias("first"), F.struct("doc_id", "lang", "text").alias("item"))
    pages = rows.groupBy("first").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return pages.select((F.col("first") / 10).cast("long").alias("page"), pretty_json(F.col("items"), ["doc_id", "lang", "text"]).alias("text"))


_INDEXES: dict[tuple, store.Store] = {}


def _stamp(spark: SparkSession, sf_dir: str, *names: str) -> tuple:
    """What tells that a folder's tables are others than before: their files' number, sizes and times."""
    about = [F.count_distinct("_metadata.file_path"), F.max("_metadata.file_modification_time"), F.sum("_metadata.file_size")]
    return tuple(tuple(table(spark, sf_dir, n).agg(*about).first()) for n in names)


@query(
    f"WITH {_DIST}, {_CHUNKS.replace('FROM documents', 'FROM documents JOIN embeddings ON doc_id = vec_id')}, held AS (SELECT dist.* FROM dist JOIN chunks USING (chunk_id)),"
    f" near20 AS (SELECT * FROM held ORDER BY distance, chunk_id LIMIT 20), near AS (SELECT * FROM near20 WHERE greatest(0, least(1, 1 - distance * distance / 2)) >= {THRESHOLD}),"
    f" {_bm25(20)}, {_fused('near')}, kept AS (SELECT * FROM fused), {_BEST} {_AND_SHOW}"
)
def indexed_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search in a store of all documents with an embedding; the session's first call builds the store."""
    key = (spark.sparkContext.applicationId, sf_dir, _stamp(spark, sf_dir, "documents", "embeddings"))
    if key not in _INDEXES:
        _INDEXES[key] = _stored(spark, sf_dir, _files(spark, sf_dir))
    first = table(spark, sf_dir, "embeddings").where("vec_id = 0").select(V.doubles(F.col("embedding")).alias("e")).first()
    results = search(_INDEXES[key], _Given(first["e"] if first else [0.0] * 64), TEXT, K, use_hybrid=True, threshold=THRESHOLD)
    return _shown(results)


class _Given:
    """Stands for an embedder that gives one vector."""

    def __init__(self, vector: list[float]) -> None:
        self.dimension, self.vector = len(vector), vector

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.array([self.vector] * len(texts))


@query(None)
def index_and_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks all documents, embeds the chunks by hashed words, stores them and asks for the nearest ones."""
    files = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/data/"), "doc_id", F.lit(".txt")).alias("path"), "text", F.lit("txt").alias("file_type"), F.lit(0).cast("long").alias("last_modified"), F.lit(0).alias("line_offset")
    )
    kept, embedder = store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", 64), HashEmbedder(64)
    index_files(kept, files.repartition("path"), embedder)  # however few row groups the table has
    return search(kept, embedder, "the attention of the station", 20).select("chunk_id", "file_path", "start_line", "end_line", F.round("score", 6).alias("score"))
