import math
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuskiln.llm import katz, near_dedup, pieces, quality, toxicity

from .conftest import text
from .test_near_dedup import brute

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def brute_katz(rows, order):
    tokens = [(k, [*re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())), "END"]) for k, t in rows]
    train = lambda k: k is None or zlib.crc32(str(k).encode()) % 7 != 2
    count, follow = Counter(), [defaultdict(Counter) for _ in range(order + 1)]
    for k, w in tokens:
        if train(k):
            count.update(w)
            said = ["START", *w]
            for n in range(2, order + 1):
                for i in range(n - 1, len(said)):
                    follow[n][tuple(said[i - n + 1 : i])][said[i]] += 1
    n_all, kinds = sum(count.values()), len(count)
    d = [None, None, *(katz.discounts([sum(r == c for f in follow[n].values() for r in f.values()) for c in range(1, 7)]) for n in range(2, order + 1))]
    kept = lambda n, r: r * (d[n][r - 1] if r <= 5 else 1)
    # A context has as many followers as it occurs: an end has none, but no context ends with one.
    own = lambda h: sum(follow[len(h) + 1][h].values())
    cache = {}

    def p(h, x):
        if not h:
            return (count[x] + 1) / (n_all + kinds + 1)
        f = follow[len(h) + 1].get(h)
        if not f:
            return p(h[1:], x)
        if f[x]:
            return kept(len(h) + 1, f[x]) / (own(h) + 1)
        if h not in cache:
            shown = [y for y in f if f[y]]
            cache[h] = (1 - sum(kept(len(h) + 1, f[y]) for y in shown) / (own(h) + 1)) / (1 - sum(p(h[1:], y) for y in shown))
        return cache[h] * p(h[1:], x)

    some = random.Random(0).sample(sorted(follow[order], key=str), min(3, len(follow[order])))
    for h in [("START",), *some, *(c[1:] for c in some)]:
        assert sum(p(h, x) for x in [*count, "unknown"]) == pytest.approx(1)
    context = lambda w, i: tuple(["START", *w][max(0, i + 2 - order) : i + 1])
    return [(k, not train(k), len(w), sum(count[x] > 0 for x in w), n_all, sum(math.log10(p((), x)) for x in w), sum(math.log10(p(context(w, i), x)) for i, x in enumerate(w))) for k, w in tokens]


def same(got, want):
    order = lambda r: (r[0] is not None, r[0] or 0, r[2], round(r[5], 6))
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


@pytest.mark.parametrize(("order", "hot"), [(2, 16384), (3, 16384), (3, 50), (4, 16384)])
def test_katz_is_the_brute_force_model(spark, monkeypatch, order, hot):
    monkeypatch.setattr(katz, "CELL_BYTES", 3000)
    if hot < 100:  # many contexts are dealt over several parts
        monkeypatch.setattr(katz, "max", lambda *x: max(5, *x[1:]), raising=False)
    rng = random.Random(8)
    rows = [(i, text(rng, rng.randint(0, 60)) + " the the" * rng.randint(0, 20)) for i in range(200)]
    rows += [(200 + i, rows[i][1] + " and more") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    from corpuskiln.llm.common import cut

    same(katz.katz_scores(cut(docs, "docs"), held_out(), order, part_bytes=5000).collect(), brute_katz(rows, order))


def test_katz_odd_rows(spark, odd_documents, no_documents):
    from corpuskiln.llm.common import cut

    docs = cut(odd_documents, "docs")
    same(katz.katz_scores(docs, held_out()).collect(), brute_katz([(r.doc_id, r.text) for r in docs.collect()], katz.ORDER))
    assert katz.katz_scores(no_documents, held_out()).count() == 0
    alone = katz.katz_scores(docs, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.score == r.base_score for r in alone)


def cells(rows):
    docs = pa.RecordBatch.from_pydict(rows)
    return pa.Table.from_batches(katz._cells(1, False)([docs])), pa.Table.from_batches(katz._cells(1, True)([docs]))


def test_katz_sends_an_ngram_once_for_a_cell(monkeypatch):
    monkeypatch.setattr(katz, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    said, asked = cells({"doc_id": [1, 2, 3], "text": ["the " * 50_000 + "end", "the the end", "the the the"], "train": [True, True, False]})
    answers = katz._count_words(1)(asked)
    replies = answers.select(["cell", "part", "block"]).append_column("level", pa.array([1] * answers.num_rows, pa.int32()))
    for n, most in ((2, 5), (3, 5)):
        grams = katz._ask(n, 1, 1000, 2)(said, replies)
        assert grams.num_rows == 1
        count = katz.spread(grams.column("block")[0].as_py())[5]
        assert len(count) == most and count.max() == 50_002 - 2 * (n - 1)
        counted = katz._count_grams(n, 1, n < 3)(grams)
        (part,) = counted.to_pylist()
        assert len(katz.spread(part["totals"][0])[0]) == most and len(grams.column("block")[0].as_py()) + len(part["totals"][0]) < 1000
        hot = {f: -1.0 for f in part["hot_first"]}
        share = pa.Table.from_batches(katz._finish(n, katz.discounts([0] * 6), np.zeros(6), hot)(counted.to_batches()))
        replies = pa.concat_tables([replies.select(share.column_names), share])


def test_katz_notices_documents_in_another_order(monkeypatch):
    monkeypatch.setattr(katz, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rows = {"doc_id": [1, 2], "text": ["one two", "two one"], "train": [True, True]}
    said, _ = cells(rows)
    for other in ({k: v[::-1] for k, v in rows.items()}, rows | {"doc_id": [2, 1]}, rows | {"train": [True, False]}):
        assert cells(other)[1].column("cell")[0] != said.column("cell")[0]
    assert cells(rows)[1].column("cell")[0] == said.column("cell")[0]


def test_discounts():
    assert ((katz.discounts([1000, 300, 150, 90, 60, 40]) > 0) & (katz.discounts([1000, 300, 150, 90, 60, 40]) < 1)).all()
    assert katz.discounts([0] * 6).tolist() == [0.5, 0.75, 2.5 / 3, 3.5 / 4, 0.9]


@pytest.mark.parametrize(("low", "high"), [(0, 9), (-2, 40), (0, 1 << 40), (-(1 << 62), 1 << 62), (5, 6)])
def test_distinct_is_numpys(low, high):
    rng = np.random.default_rng(3)
    for size in (0, 1, 700):
        values = np.concatenate([rng.integers(low, high, size)] * 2)
        for a, b in zip(katz._distinct(values), np.unique(values, return_index=True, return_inverse=True, return_counts=True), strict=True):
            assert (a == b).all() and len(a) == len(b)
        assert (katz._sorted(values)[1] == np.argsort(values, kind="stable")).all()
    hashed = rng.integers(0, 1 << 64, 50, dtype=np.uint64)[rng.integers(0, 50, 900)]
    assert all((a == b).all() for a, b in zip(katz._distinct_hashes(hashed), np.unique(hashed, return_inverse=True), strict=True))


def test_katz_replays_an_order_without_what_only_asking_needs(monkeypatch):
    monkeypatch.setattr(katz, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    said, asked = cells({"doc_id": [1], "text": ["a b a b c a b"], "train": [True]})
    answers = katz._count_words(1)(asked)
    replies = answers.select(["cell", "part", "block"]).append_column("level", pa.array([1] * answers.num_rows, pa.int32()))
    cell = katz._Cell(said, replies, 2, 1, 1000, 1)
    full, again = cell.next_order(), cell.next_order(ask=False)
    assert (full.place == again.place).all() and (full.own == again.own).all() and hasattr(full, "seen") and not hasattr(again, "seen")


def test_blocks_come_back():
    arrays = [np.arange(5, dtype=np.uint32), np.zeros(0, np.int64), np.array([1.5, -2]), np.array([True, False])]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, katz.spread(katz.squeeze(*arrays)), strict=True))


@pytest.mark.parametrize("chunk", [64, 300, 100_000])
def test_pieces_are_the_librarys(spark, odd_documents, chunk):
    rng = random.Random(chunk)
    texts = [text(rng, 200), "a" * 500, " " * 200, "thethe" * 90, "".join(rng.choices("ab é日\n😀t", k=700))]
    rows = odd_documents.where("doc_id < 6 or doc_id > 8 or doc_id is null").select("doc_id", "text", "row").unionByName(spark.createDataFrame([(100 + i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, row string"))
    library = pieces.Vocabulary(MODEL).library
    coded = pieces.encode(rows, MODEL, chunk)
    whole = defaultdict(list)
    for r in coded.collect():
        whole[r.row, r.doc_id].append((r.part, r.first_id, list(r.ids)))
    got = []
    for (_, key), parts in whole.items():
        ids = []
        for _, first, own in sorted(parts):
            assert first == len(ids)
            ids += own
        got.append((key, ids))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(got, key=order) == sorted([(r.doc_id, library.encode(r.text or "")) for r in rows.collect()], key=order)
    assert all(r.exact for r in pieces.checked(coded, MODEL).collect())
    spelt = defaultdict(list)
    for r in pieces.decode(coded, MODEL).collect():
        spelt[r.row, r.doc_id].append((r.part, r.text))
    assert sorted("".join(t for _, t in sorted(p)) for p in spelt.values()) == sorted(r.text or "" for r in rows.collect())


def test_many_chunks_are_combined_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(pieces, "FAN", 3)
    rng = random.Random(9)
    texts = [text(rng, 300), "ab" * 900, "short", " " * 700 + "x", text(rng, 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = pieces.encode(docs, MODEL, 64)
    got = defaultdict(list)
    for r in sorted(coded.collect(), key=lambda r: (r.doc_id, r.part)):
        assert r.first_id == len(got[r.doc_id])
        got[r.doc_id] += r.ids
    library = pieces.Vocabulary(MODEL).library
    assert got == {k: library.encode(t) for k, t in enumerate(texts)}
    same = pieces.checked(pieces.encode(docs, MODEL, 64, then=pieces.check(MODEL))).collect()
    assert sorted(map(tuple, same)) == sorted(map(tuple, pieces.checked(coded, MODEL).collect())) and all(r.exact for r in same)


def test_a_literal_space_mark_stays_at_every_size(spark):
    rng = random.Random(4)
    texts = ["▁" + text(rng, 30) + "▁▁ ▁" + text(rng, 30) + "▁", "a\x00 ▁" * 60, text(rng, 60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = []
    for chunk in (64, 100_000):
        coded = pieces.encode(docs, MODEL, chunk)
        said = defaultdict(str)
        for r in sorted(coded.collect(), key=lambda r: r.part):
            said[r.doc_id] += r.text
        assert [said[k] for k in range(3)] == texts
        found.append(sorted(map(tuple, pieces.checked(coded, MODEL).collect())))
    assert found[0] == found[1] and [r[-1] for r in found[0]] == [False, False, True]


def test_pieces_of_no_rows(no_documents):
    assert pieces.checked(pieces.encode(no_documents, MODEL), MODEL).count() == 0


def test_pipeline_stages_against_what_they_say(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, folder)
        if name == "toxicity":
            want = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 0").collect()}
        elif name == "quality":
            want = {r.doc_id for r in quality.quality(docs, labels).where("predicted = 1").collect()}
        elif name == "near_duplicates":
            want = {k for k, (_, root) in brute(rows.items(), 80).items() if k == root}
        else:
            assert {r.doc_id for r in out.collect()} == set(rows)
            break
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert {r.doc_id for r in docs.collect()} == want and docs.count() == len(want)
    assert corpus_pipeline.run(spark, folder).count() == out.count()


def test_pipeline_stages_on_odd_rows(spark, odd_documents, no_documents):
    folder = "/root/testdata/sf0.001"
    docs = odd_documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == odd_documents.columns, name
        assert stage(spark, no_documents, folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= docs.count() > 0
    left = corpus_pipeline.drop_near_duplicates(spark, odd_documents, folder)
    assert left.where("doc_id = 9").count() == 1 and left.where("doc_id is null").count() == 2
    assert near_dedup.BLOCK == 1024


@pytest.mark.parametrize("left", ["false", "toxic is null", "crc32(cast(doc_id as string)) % 4 = 2"])
def test_pipeline_without_labels_keeps_every_document(spark, odd_documents, tmp_path, left):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    labels.where(left).write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.drop_toxic(spark, odd_documents, str(tmp_path))
    assert kept.columns == odd_documents.columns and kept.count() == odd_documents.count()
