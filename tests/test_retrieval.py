import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskiln.operators import rerank, retrieval
from corpuskiln.operators.embedding import HashEmbedder, HttpEmbedder, Swappable, Unavailable, available, embedded, mean_pool

Q = [0.5, 0.5, 0.5, 0.5]


@pytest.fixture(scope="module")
def tables(spark):
    vectors = spark.createDataFrame([(0, [0.5, 0.5, 0.5, 0.6]), (1, [0.1, 0.9, 0.2, 0.7]), (2, None), (3, [1.0])], "chunk_id long, embedding array<float>")
    chunks = spark.createDataFrame([(0, "/n/a.md", 1, 2, "Quiet harbour"), (1, "/n/b.RS", 3, 4, "Busy harbour")], "chunk_id long, file_path string, start_line int, end_line int, content string")
    return vectors, chunks


def test_nearest(tables):
    rows = retrieval.nearest(tables[0], Q, 5).collect()
    assert [r.chunk_id for r in rows] == [0, 1]
    assert [round(r.distance, 5) for r in rows] == [0.1, 0.67082]
    assert retrieval.with_threshold(retrieval.nearest(tables[0], Q, 5), 0.95).count() == 1
    assert retrieval.with_threshold(retrieval.nearest(tables[0], Q, 5), None).count() == 2


def test_hybrid(tables):
    rows = {r.chunk_id: r.score for r in retrieval.hybrid(*tables, Q, "quiet", 5).collect()}
    assert rows[0] == 1.0 and round(rows[1], 6) == 0.491935
    assert [r.chunk_id for r in retrieval.hybrid(*tables, Q, "quiet", 5, 0.95).collect()] == [0]
    assert retrieval.hybrid(*tables, Q, 'a" AND (', 5).count() == 2


def test_fusing_does_not_depend_on_the_arms_order(spark):
    a = spark.createDataFrame([(1, 0.1), (2, 0.2)], "chunk_id long, distance double")
    b = spark.createDataFrame([(2, 5.0), (3, 4.0)], "chunk_id long, bm25 double")
    got = {r.chunk_id: r.rrf for r in retrieval.fused(a, b).collect()}
    assert got == pytest.approx({1: 1 / 61, 2: 1 / 62 + 1 / 61, 3: 1 / 62})


def test_lexical_needs_all_words(tables, spark):
    assert [r.chunk_id for r in retrieval.lexical(tables[1], "HARBOUR busy", 5).collect()] == [1]
    assert retrieval.lexical(tables[1], "  ", 5).count() == 0
    terms, lengths = retrieval.postings(tables[1])
    assert retrieval.lexical_indexed(terms, lengths, "harbour", 5).collect() == retrieval.lexical(tables[1], "harbour", 5).collect()


def test_types(tables):
    assert [r.chunk_id for r in retrieval.of_types(tables[1], ["rs"]).collect()] == [1]
    assert retrieval.of_types(tables[1], []).count() == 2


@pytest.mark.parametrize(
    ("args", "want"),
    [
        ('{"query": "q"}', (5, None, None)),
        ('{"query": "q", "top_k": 100, "threshold": 0.5}', (100, 0.5, None)),
        ('{"query": "q", "top_k": "x", "threshold": 2}', (5, None, None)),
        ('{"query": "q", "top_k": 0}', (0, None, "Invalid top_k: must be between 1 and 100")),
        ("{}", (5, None, "Missing required parameter: query")),
    ],
)
def test_arguments(spark, args, want):
    got = retrieval.tool_arguments(F.lit(args))
    assert tuple(spark.range(1).select(got["top_k"], got["threshold"], got["error"]).first()) == want


def test_embedders(spark):
    e = HashEmbedder(16)
    v = e.embed(["one two", "one two", ""])
    assert (v[0] == v[1]).all() and round(float((v[0] ** 2).sum()), 6) == 1 and not v[2].any()
    with pytest.raises(ValueError):
        HttpEmbedder("ftp://x", "m", 3)
    with pytest.raises(RuntimeError):
        Unavailable().embed(["x"])
    with pytest.raises(ValueError):
        Swappable(e).swap(HashEmbedder(8))
    assert not HttpEmbedder("http://127.0.0.1:9", "m", 3).answers(0.2)
    rows = embedded(spark.createDataFrame([(1, "one two"), (2, None)], "chunk_id long, content string"), e).collect()
    assert len(rows[0].embedding) == 16
    import numpy as np

    assert mean_pool(np.array([[[1.0], [3.0], [9.0]]]), np.array([[1, 1, 0]])).tolist() == [[2.0]]


def test_http_embedder(spark):
    class Answers(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            body = json.dumps({"model": asked["model"], "embeddings": [[float(len(t)), 1.0] for t in asked["input"]]}).encode()
            self.send_response(200 if self.path == "/api/embed" else 404)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/"
        e = HttpEmbedder(url, "m", 2)
        assert e.answers() and available(e, HashEmbedder(2)) is e and e.embed(["abc"]).tolist() == [[3.0, 1.0]]
        rows = embedded(spark.createDataFrame([(k, "x" * k) for k in range(70)], "chunk_id long, content string"), e).collect()
        assert [r.embedding[0] for r in rows] == [float(k) for k in range(70)]
        wrong = HttpEmbedder(url, "m", 3)
        with pytest.raises(ValueError, match="dimension 3"):
            wrong.embed(["abc"])
        other = HashEmbedder(3)
        assert available(wrong, other) is other
    finally:
        server.shutdown()


def test_rerank(tables):
    got = rerank.reranked(tables[1], "busy moon", rerank.Overlap()).collect()
    assert [(r.chunk_id, r.score) for r in got] == [(1, 0.5), (0, 0.0)]


def test_a_worker_loads_a_model_once(monkeypatch, tmp_path):
    import sys
    import types

    from corpuskiln.operators import embedding

    made = []

    class Coded:
        ids, attention_mask, type_ids = [1, 2], [1, 1], [0, 0]

    class Tokenizer:
        @classmethod
        def from_file(cls, file):
            made.append(file)
            return cls()

        enable_truncation = enable_padding = lambda self, *a: None
        encode_batch = lambda self, texts: [Coded for _ in texts]

    class Session:
        def __init__(self, model):
            made.append(model)

        get_inputs = lambda self: [types.SimpleNamespace(name="input_ids")]
        run = lambda self, _, fields: [np.ones((*fields["input_ids"].shape, 3))]

    monkeypatch.setitem(sys.modules, "onnxruntime", types.SimpleNamespace(InferenceSession=Session))
    monkeypatch.setitem(sys.modules, "tokenizers", types.SimpleNamespace(Tokenizer=Tokenizer))
    embedding.onnx_session.cache_clear()
    for _ in range(3):  # as copies that come with tasks
        out = embedding.OnnxEmbedder("m.onnx", "t.json", 3).embed(["a", "b"])
    assert made == ["t.json", "m.onnx"] and out.shape == (2, 3) and np.allclose((out**2).sum(1), 1)
    embedding.onnx_session.cache_clear()
