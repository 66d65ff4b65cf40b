from corpuskiln.config import Config
from corpuskiln.functions.sql import register
from corpuskiln.operators.chunking import chunks


def test_config_round_trip():
    config = Config(chunk_size=100, relevance_threshold=0.5, watched_paths=['/a "b"', "/c"], hybrid_search=True)
    assert Config.from_toml(config.to_toml(), {}) == config
    assert Config.from_toml("unknown = 1", {}) == Config()
    assert Config.from_toml("", {"KILN_CHUNK_SIZE": "7"}).chunk_size == 7


def test_chunks_in_sql(spark):
    register(spark)
    files = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id as key", "'/x.txt' as path", "text")
    files.createOrReplaceTempView("files")
    got = spark.sql("SELECT key, c.chunk_index, c.start_line, c.end_line, c.content FROM files, LATERAL chunk_text(text, path, 'fallback') c")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunks(files).drop("path").collect()))
