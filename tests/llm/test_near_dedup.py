import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuskiln.llm import near_dedup
from corpuskiln.llm.common import components
from corpuskiln.llm.words import shingle_sets

from .conftest import text


def brute(rows, percent):
    sets = {}
    for key, words in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (words or "").encode()))
        sets[key] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def corpus(seed, families, members, edits, size=60):
    rng = random.Random(seed)
    rows = []
    for _ in range(families):
        base = text(rng, size).split()
        for _ in range(members):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = rng.choice(base) + "z"
            rows.append((len(rows) * 3, " ".join(own)))
    return rows


@pytest.mark.parametrize(("percent", "edits", "rounds"), [(85, 2, 2), (80, 3, 0), (85, 1, 1)])
def test_same_as_brute_force(spark, percent, edits, rounds, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)  # long buckets are compared in blocks
    rows = corpus(percent + rounds, 5, 14, edits)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent, star_rounds=rounds).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(odd_documents):
    got = near_dedup.near_duplicates(odd_documents).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == 17 and len(by) == 15
    assert [by[k].n_shingles for k in (1, 2, 3, 4, 8)] == [0, 0, 0, 1, 1] and by[1].kept and by[2].kept and by[3].kept
    assert by[5].component_id == 4 and by[7].component_id == 6 and not by[7].kept
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)


@pytest.mark.parametrize("flip", [False, True])
def test_one_text_counts_where_a_doc_id_repeats(spark, flip):
    rng = random.Random(5)
    t1, t2 = sorted([text(rng, 80), text(rng, 40)], reverse=flip)
    near = t2 + " more"
    rows = [(5, t1), (5, t2), (9, t2), (12, near), (20, None), (20, t1), (30, t1 + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    least = {}
    for key, words in rows:
        least[key] = min(least.get(key, words or ""), words or "")
    got = near_dedup.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(list(least.items()), 85) and len(got) == 5
    left = {r.doc_id: r.text or "" for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert left == {k: least[k] for k, (_, root) in brute(list(least.items()), 80).items() if k == root}


def test_no_rows(no_documents):
    assert near_dedup.near_duplicates(no_documents).count() == 0


def test_sketch_agrees_as_often_as_the_sets_are_alike():
    rng = np.random.default_rng(1)
    for size in (3, 40, 4000):
        a = rng.integers(0, 2**63, size, dtype=np.uint64)
        b = np.concatenate([a[: size * 2 // 3], rng.integers(0, 2**63, size - size * 2 // 3, dtype=np.uint64)])
        alike = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        same = (near_dedup.one_permutation_sketch(a, 1 << 13) == near_dedup.one_permutation_sketch(b, 1 << 13)).mean()
        assert abs(same - alike) < (0.35 if size == 3 else 0.08)


def test_words_are_told_apart_by_their_bytes():
    one, two, three = shingle_sets(pa.array(["a b c d e f", "A\tB\x0bc  d\ne f", "a b c d e\xa0f"]))
    assert (one == two).all() and len(three) == 1


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(30)}}


def test_a_salt_needs_no_join(spark):
    rows = spark.range(4000).selectExpr("if(id < 1000, 7, id) AS bucket", "id AS rep")
    hot = near_dedup.hot_keys(rows.groupBy("bucket").count().withColumnRenamed("count", "n"), "bucket")
    for some, most in ((hot, 4), (hot.where("false"), 1)):
        got = near_dedup.salted(rows, some, "bucket", "rep")
        assert "Join" not in got._jdf.queryExecution().toString()
        salts = {r.hot: r.salts for r in got.groupBy((F.col("bucket") == 7).alias("hot")).agg(F.countDistinct("salt").alias("salts")).collect()}
        assert got.count() == 4000 and salts == {True: most, False: 1}


def test_members_too_far_apart_are_not_compared_pair_by_pair(spark, monkeypatch):
    rng, finish, left = random.Random(8), near_dedup._State.finish, []
    monkeypatch.setattr(near_dedup._State, "finish", lambda self, alive, hot: left.append(alive.count()) or finish(self, alive, hot))
    base, rows = text(rng, 150).split(), []
    for key in range(60):
        own = list(base)
        for at in rng.sample(range(4, 145), 1 if key < 12 else 3):
            own[at] = f"own{key}x{at}"
        rows.append((key, " ".join(own)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), star_rounds=0).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 85)
    assert sum(left) < 12 * 20
