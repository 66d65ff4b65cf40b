import hashlib
import math
import os
import random
import textwrap
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuskiln.llm import chat, licences, topk

PARTS = [*"<>|[]/\\sINTYend_ \n", "<|end|>", "</s>", "[INST]", "<|start|>", "<SYS>", "é😀"]
CONTROL_TEXT = st.lists(st.sampled_from(PARTS), max_size=20).map("".join)


@given(st.lists(st.tuples(CONTROL_TEXT, CONTROL_TEXT), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_formatting_can_be_read_back(turns):
    roles, texts = zip(*turns, strict=True)
    buffer, ends, at, size = chat.assemble(pa.array(roles), pa.array(texts))
    said = buffer.to_pybytes()
    assert chat.read_back(said) == turns
    assert [chat.unescape(said[a : a + n].decode()) for a, n in zip(at, size, strict=True)] == list(texts)
    plain = chat.escape(pa.array(texts)).to_pylist()
    assert not any(c in p for p in plain for c in ("<|end|>", "</s>", "[INST]", "<|start|>", "<SYS>"))


def test_digests(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", None, "tool"]), rng.choice([None, "", "x</s>y", "é" * 5000, "plain"]), 1, "p") for c in [None, *range(30)] for t in range(rng.randint(1, 20))]
    rows += [(99, None, "assistant", "b", 1, "p"), (99, 1, "assistant", "b", 1, "p"), (99, 1, "assistant", "b", 1, "p"), (99, 1, "assistant", "a", 1, "p")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece int, turns string")
    got = {r.conv_id: r for r in chat.digests(chat.format_chat(frame, 3)).collect()}
    by_bytes = chat.format_chat(frame, 100, 6000)
    assert sorted(map(str, chat.digests(by_bytes).collect())) == sorted(map(str, got.values())) and by_bytes.where("length(text) > 6000").where("turns > 1").isEmpty()
    want = {}
    for c, t, role, words, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", words or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(w for r, w in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{w}\n" for r, w in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.format_chat(frame.limit(0))).count() == 0


def test_licences(spark, odd_documents, no_documents):
    known = licences.known_licences(spark)
    mit = dict((k, v) for k, v in licences.KNOWN if v.startswith("Permission is hereby"))["MIT"]
    texts = [(1, "Copyright (c) 2020 Someone\nAll rights reserved\n\n" + mit.upper().replace(" ", "\n", 30)), (2, "prose\n  released under the M.I.T licence!\nreleased under the mit license\nLicensed under CC BY-NC 4.0."), (3, mit + " And more.")]
    got = {r.doc_id: r for r in licences.licences(spark.createDataFrame(texts, "doc_id long, text string"), known).collect()}
    assert got[1].text_licence == "MIT" and got[3].text_licence is None
    assert (got[2].text_licence, got[2].notice_lines, got[2].notice_licences) == (None, 2, "CC-BY-NC-4.0,MIT")
    odd = licences.licences(odd_documents, known).collect()
    assert len(odd) == 17 and all(r.text_licence is None and r.notice_lines == 0 and r.notice_licences is None for r in odd)
    assert licences.licences(no_documents, known).count() == 0
    assert licences.licences(odd_documents, known.limit(0)).where("notice_lines > 0").count() == 0


def test_licences_are_found_at_every_width(spark):
    full = [(name, t) for name, t in licences.KNOWN if len(t) > 300]
    heads = ["", "Copyright (c) 2020, 2021 Jane Doe\n\n", "/* Copyright 1999 The Authors.\n * All rights reserved.\n */\n", "(c) 2011 by me\n", "© 2003 Someone\n", "Copyright by The People\n"]
    rows, want = [], {}
    for name, words in full:
        for width in range(30, 131):
            want[len(rows)] = name
            mark = "# " if width % 3 == 0 else ""
            rows.append((len(rows), heads[width % len(heads)] + "\n".join(mark + x for x in textwrap.wrap(words, width))))
    got = {r.doc_id: r.text_licence for r in licences.licences(spark.createDataFrame(rows, "doc_id long, text string"), licences.known_licences(spark)).collect()}
    assert got == want and len(full) == 9


COMMON = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no licence files here")
def test_licences_given_as_files(spark, tmp_path):
    names = ["Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0", "CC0-1.0"]
    docs = []
    for name in names:
        with open(f"{COMMON}/{name}") as file:
            text = file.read()
        (tmp_path / name).write_text(text)
        # A copyright line is left out by its line; where there is one, lines stay.
        other = "\n".join(f"  {line}  " for line in text.upper().splitlines()) if "GPL" in name else textwrap.fill(" ".join(text.split()), 61).upper()
        docs += [(len(docs), name, text), (len(docs) + 1, name, other), (len(docs) + 2, None, text.replace("the", "teh", 1))]
    got = licences.licences(spark.createDataFrame([(k, t) for k, _, t in docs], "doc_id long, text string"), licences.known_licences(spark, str(tmp_path)))
    assert {r.doc_id: r.text_licence for r in got.collect()} == {k: name for k, name, _ in docs}


def test_every_text_of_a_doc_id_has_its_licence(spark):
    mit, isc = (next(t for k, t in licences.KNOWN if k == name and len(t) > 300) for name in ("MIT", "ISC"))
    rows = [(1, mit), (1, isc), (1, isc), (1, None), (None, mit), (None, "x\nReleased under the MIT License."), (None, "x\nReleased under the MIT License.")]
    got = licences.licences(spark.createDataFrame(rows, "doc_id long, text string"), licences.known_licences(spark)).collect()
    assert sorted((r.doc_id or 0, r.text_licence or "", r.notice_lines) for r in got) == [(0, "", 1), (0, "MIT", 1), (1, "", 0), (1, "ISC", 1), (1, "MIT", 1)]


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-9, 9, (600, 5))
    rows = [(i * 7 % 601, v.tolist(), "x", 0) for i, v in enumerate(x)]
    rows += [(2000, None, "x", 0), (None, [1] * 5, "x", 0), (2020, [1, 2], "x", 0), (2040, [1, 1], "x", 0), (2060, [], "x", 0)]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<long>, shard string, kind int")
    for k, shard_rows in ((20, 10_000), (7, 64)):
        got = topk.top_k(frame, frame.where("vec_id % 20 = 0"), k, shard_rows).collect()
        want = []
        usable = [(i, v) for i, v, *_ in rows if i is not None and v is not None]
        for i, v in usable:
            if i % 20 == 0:
                scores = sorted((-int(np.dot(v, w)), j) for j, w in usable if j != i and len(w) == len(v))[:k]
                want += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores, 1)]
        assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_repeated_rows_are_candidates_each(spark):
    frame = spark.createDataFrame([(20, [1, 0]), (20, [1, 0]), (1, [3, 0]), (1, [3, 0]), (2, [3, 9])], "vec_id long, vector array<long>")
    assert sorted(map(tuple, topk.top_k(frame, frame.where("vec_id = 20"), 20).collect())) == [(20, 1, 1, 3), (20, 2, 1, 3), (20, 3, 2, 3)]


def test_quantised(spark):
    rows = [(1, [0.5, -0.01]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [])]
    got = {r.vec_id: r.vector for r in topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {1: [32, -1], 2: None, 3: None, 4: None, 5: []}


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-4, 5, (90, 4)) / 3 * 10.0 ** rng.integers(-2, 37, (90, 4))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(100, [1e30, 1.0, 0.0, 0.0]), (120, [1e30, 1.0, 0.0, 0.0]), (101, [1e30, 1.03125, 0.0, 0.0]), (140, [float("inf"), 0.0, 0.0, 0.0]), (160, [2.0**20, 2.0**21, 1.0, 0.5]), (161, [2.0**20, 2.0**21, 1.0, 1.5])]
    frame = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    whole = {i: [math.floor(64 * Fraction(float(np.float32(c)))) for c in v] for i, v in rows if np.isfinite(v).all()}
    want = []
    for i, v in whole.items():
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in whole.items() if j != i)[:20]
            want += [(i, rank, j, max(min(-s, 2**63 - 1), -(2**63))) for rank, (s, j) in enumerate(scores, 1)]
    for shard_rows in (16, 1000):
        assert sorted(map(tuple, topk.top_k(frame, frame.where("vec_id % 20 = 0"), 20, shard_rows).collect())) == sorted(want)


def test_sort_keys_are_in_order():
    numbers = sorted([s * (10**e + d) for e in (17, 18, 30, 80) for d in (0, 1, 7) for s in (1, -1)])
    assert [topk.sort_key(n) for n in numbers] == sorted(topk.sort_key(n) for n in numbers) and topk.sort_key(2**53 - 1) == ""
