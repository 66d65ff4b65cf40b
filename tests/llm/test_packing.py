import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpuskiln.llm import packing

from .conftest import text

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@given(st.integers(1, 20000))
@settings(max_examples=300, deadline=None)
def test_cuts(n):
    found = packing.cuts(n)
    assert sum(found) == n and all(0 < x <= 2048 for x in found)
    assert all(x >= packing.LEAST and 2048 // x * x > 2048 - 2048 // x for x in found[:-1])


@given(st.lists(st.sampled_from(["a", "Ab", "'ll", "'S", "12", "3", " ", "  ", "\t", "\n", "\r\n", "\u00a0", "\u3000", "é", "e\u0301", "中文", "😀", "👩‍👩‍👧", "\u200b", "\ufeff", "\x00", "ß", "ſ", "İ", "٣", "²", "_", "!?", "<|endoftext|>", "<|"]) | st.text(max_size=4), max_size=30).map("".join))
@settings(max_examples=2000, deadline=None)
def test_ids_are_those_of_tokenizers(words):
    tokens = packing._tokens("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    words = words.encode("utf-8", "ignore").decode()
    assert tokens.ids(words).tolist() == tokens.whole.encode(words, add_special_tokens=False).ids


def check(rows, texts):
    tokenizer = Tokenizer.from_file(JSON)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for key, words in texts.items():
        ids = [*tokenizer.encode(words or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[key], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return sum(r.length for r in rows) / (2048 * len(by_sequence))


def test_pieces_are_the_documents(spark):
    rng = random.Random(2)
    texts = {i: text(rng, rng.choice([1, 30, 400, 3000])) for i in range(120)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(2)
    fast = packing.with_digest(packing.pack(docs, JSON, RANKS)).collect()
    assert check(fast, texts) > 0.97
    slow = packing.with_digest(packing.pack(docs, JSON)).collect()
    assert sorted(map(tuple, fast)) == sorted(map(tuple, slow))


def test_odd_rows(odd_documents, no_documents):
    docs = odd_documents.where("doc_id is not null").dropDuplicates(["doc_id"])
    check(packing.with_digest(packing.pack(docs, JSON, RANKS)).collect(), {r.doc_id: r.text for r in docs.collect()})
    rows = packing.pack(odd_documents, JSON, RANKS).collect()
    assert sum(r.length for r in rows if r.doc_id is None) == sum({r.doc_tokens for r in rows if r.doc_id is None})
    assert packing.pack(no_documents, JSON, RANKS).count() == 0


def test_long_runs_of_white_space(spark):
    texts = {1: " " * 1_000_000, 2: "\n" * 1_000_000, 3: "a " + " \n\t" * 400_000 + "b", 4: "plain"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    check(packing.with_digest(packing.pack(docs, JSON, RANKS)).collect(), texts)
