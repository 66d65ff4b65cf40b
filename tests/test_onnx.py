"""The ONNX forms of embedder and reranker with small models, written here as the protocol buffers that ONNX files are."""

import numpy as np
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers, processors

from corpuskiln.operators.embedding import OnnxEmbedder, embedded
from corpuskiln.operators.rerank import OnnxReranker, reranked

FLOAT, INT64 = 1, 7
WORDS = {"[PAD]": 0, "[UNK]": 1, "[SEP]": 2, "quick": 3, "fox": 4, "slow": 5, "turtle": 6}


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def tensor(name, values):
    kind = FLOAT if values.dtype == np.float32 else INT64
    return b"".join(field(1, n) for n in values.shape) + field(2, kind) + field(8, name) + field(9, values.tobytes())


def info(name, kind, *shape):
    dims = b"".join(field(1, field(2, n)) for n in shape)
    return field(1, name) + field(2, field(1, field(1, kind) + field(2, dims)))


def node(op, inputs, output, **attributes):
    attrs = b"".join(field(5, field(1, k) + field(3, v) + field(20, 2)) for k, v in attributes.items())
    return b"".join(field(1, i) for i in inputs) + field(2, output) + field(4, op) + attrs


def model(nodes, tensors, output):
    inputs = [info(n, INT64, "batch", "tokens") for n in ("input_ids", "attention_mask", "token_type_ids")]
    graph = b"".join(field(1, n) for n in nodes) + field(2, "g") + b"".join(field(5, t) for t in tensors) + b"".join(field(11, i) for i in inputs) + field(12, output)
    return field(1, 8) + field(7, graph) + field(8, field(2, 13))


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("onnx")
    coder = Tokenizer(models.WordLevel(WORDS, "[UNK]"))
    coder.pre_tokenizer = pre_tokenizers.Whitespace()
    coder.post_processor = processors.TemplateProcessing(single="$A", pair="$A [SEP] $B:1", special_tokens=[("[SEP]", 2)])
    coder.save(str(folder / "tokenizer.json"))
    table = np.random.default_rng(1).normal(size=(len(WORDS), 4)).astype(np.float32)
    (folder / "embed.onnx").write_bytes(model([node("Gather", ["table", "input_ids"], "hidden")], [tensor("table", table)], info("hidden", FLOAT, "batch", "tokens", 4)))
    # A pair's score is the sum over its tokens of their values where they belong to the passage.
    worth = np.array([[0], [0], [0], [2], [1], [-1], [-3]], np.float32)
    steps = [node("Gather", ["worth", "input_ids"], "each"), node("Cast", ["token_type_ids"], "passage", to=FLOAT), node("Unsqueeze", ["passage", "last"], "own"), node("Mul", ["each", "own"], "kept"), node("ReduceSum", ["kept", "first"], "logits", keepdims=0)]
    (folder / "rank.onnx").write_bytes(model(steps, [tensor("worth", worth), tensor("last", np.array([2])), tensor("first", np.array([1]))], info("logits", FLOAT, "batch", 1)))
    return folder, table


def test_embedder(spark, files):
    folder, table = files
    texts = ["quick fox", "slow", "fox fox turtle unheard", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string").repartition(2)
    got = {r.chunk_id: r.embedding for r in embedded(rows, OnnxEmbedder(str(folder / "embed.onnx"), str(folder / "tokenizer.json"), 4)).collect()}
    for k, text in enumerate(texts):
        mean = np.mean([table[WORDS.get(w, 1)] for w in (text or "").split()] or [np.zeros(4)], axis=0)
        assert np.allclose(got[k], mean / max(np.linalg.norm(mean), 1e-12), atol=1e-6), text


def test_reranker(spark, files):
    folder, _ = files
    texts = ["slow turtle", "quick fox", "fox", "unheard", "quick quick turtle"]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    ranker = OnnxReranker(str(folder / "rank.onnx"), str(folder / "tokenizer.json"))
    got = reranked(rows, "quick", ranker).collect()
    value = {"slow": -1, "turtle": -3, "quick": 2, "fox": 1}
    want = [1 / (1 + np.exp(-sum(value.get(w, 0) for w in t.split()))) for t in texts]
    assert [r.chunk_id for r in got] == sorted(range(5), key=lambda k: (-want[k], k))
    assert np.allclose([r.score for r in got], sorted(want, reverse=True))
    raw = reranked(rows, "quick", OnnxReranker(str(folder / "rank.onnx"), str(folder / "tokenizer.json"), logits=False)).collect()
    assert {r.score for r in raw} == {0.0, 1.0}


def test_a_model_that_is_too_large_is_refused(tmp_path):
    with open(tmp_path / "big.onnx", "wb") as file:
        file.truncate(301 << 20)
    with pytest.raises(MemoryError):
        OnnxReranker(str(tmp_path / "big.onnx"), "t.json")
