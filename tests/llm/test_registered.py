"""The registered queries that have no SQL, as they are registered, against plain Python on the smallest tables."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpuskiln.llm import pieces
from corpuskiln.llm.queries import queries

from .conftest import text
from .test_katz_pieces_pipeline import brute_katz, same

DATA = "/root/testdata/sf0.001"


def read(name, *columns):
    rows = pq.read_table(f"{DATA}/{name}.parquet").select(list(columns)).to_pylist()
    return [tuple(r[c] for c in columns) for r in rows]


def crc(doc):
    return zlib.crc32(str(doc).encode())


@pytest.mark.parametrize(("name", "label", "held"), [("op5_quality", "quality", lambda d: crc(d) % 5 == 0), ("op6_toxicity", "toxic", lambda d: crc(d) % 4 == 2)])
def test_models(spark, name, label, held):
    got = queries()[name](spark, DATA)
    assert got.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(d for (d,) in read("documents", "doc_id"))
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    truth = dict(read("labels", "doc_id", label))
    known = [(r.predicted == truth[r.doc_id], r.held_out) for r in rows if truth.get(r.doc_id) is not None]
    assert np.mean([right for right, out in known if not out]) > 0.9
    assert np.mean([right for right, out in known if out]) > 0.75


def test_packing(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = queries()["op7_packing"](spark, DATA)
    assert got.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("doc_tokens", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got.collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    texts = dict(read("documents", "doc_id", "text"))
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : at].tobytes())
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_katz(spark):
    documents = read("documents", "doc_id", "text")
    got = queries()["op9_katz_scores"](spark, DATA)
    same(got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect(), brute_katz(documents, 3))


def test_pieces(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = dict(read("documents", "doc_id", "text"))
    want = []
    for doc, text in texts.items():
        ids = library.encode(text or "")
        want.append((doc, len(ids), sum((k + 1) * x for k, x in enumerate(ids)) % 1_000_000_007, library.decode(ids) == (text or "")))
    assert sorted(map(tuple, queries()["op10_pieces"](spark, DATA).collect())) == sorted(want)


def test_texts_beyond_the_production_chunk(spark):
    rng, model = random.Random(11), public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = [text(rng, 20_000), "".join(rng.choices("ab ▁é日😀\n", k=70_000)), "x" * 100_000, " " * 40_000 + "y"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = []
    for doc, words in enumerate(texts):
        ids = library.encode(words)
        want.append((doc, len(ids), sum((k + 1) * x for k, x in enumerate(ids)) % 1_000_000_007, library.decode(ids) == words))
    assert sorted(map(tuple, pieces.checked(pieces.encode(frame, model, then=pieces.check(model))).collect())) == want
