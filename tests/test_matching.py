"""Full-text matches against plain loops over words."""

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuskiln.operators.embedding import HashEmbedder
from corpuskiln.operators.matching import Near, Phrase, Prefix, best_matches, matched
from corpuskiln.operators.retrieval import lexical_indexed, postings
from corpuskiln.operators.store import Store
from corpuskiln.plans.search import index_files


def words_of(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def count(unit, text):
    w, own = words_of(text), words_of(unit.text)
    if isinstance(unit, Phrase):
        return sum(w[i : i + len(own)] == own for i in range(len(w))) if own else 0
    if isinstance(unit, Prefix):
        return sum(x.startswith(own[0]) for x in w)
    return sum(w[i] in own and set(own) <= set(w[i : i + unit.within + 2]) for i in range(len(w)))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["a", "B", "ab", "abc", "c,", "d.\nd", "été"], k=rng.randint(0, 25))) for _ in range(120)] + [None, "", "--", "a a a a"]
    rows = list(enumerate(texts))
    return rows, postings(spark.createDataFrame(rows, "chunk_id long, content string"))


UNITS = [Phrase("a"), Phrase("a b"), Phrase("A, a a"), Phrase("été ab c"), Phrase("zzz"), Prefix("ab"), Prefix("Ét"), Near("a c", 0), Near("a b abc", 3), Near("d", 2), Phrase("")]


def test_positions(corpus):
    rows, (terms, lengths) = corpus
    want = sorted((w, k, [i for i, x in enumerate(words_of(t)) if x == w]) for k, t in rows for w in set(words_of(t)))
    assert sorted((r.term, r.chunk_id, r.positions) for r in terms.collect()) == want
    assert terms.where("tf <> size(positions)").count() == 0
    assert {r.chunk_id: r.length for r in lengths.collect()} == {k: len(words_of(t)) for k, t in rows}


def test_units_and_what_must_not_be_there(corpus):
    rows, (terms, _) = corpus
    got = {}
    for a, b, no in [(u, None, None) for u in UNITS] + [(Phrase("a"), (Phrase("zzz"), Prefix("abc")), Near("d c", 1)), (Near("a b", 2), Phrase("c"), Phrase("a a"))]:
        wanted = [a] if b is None else [a, b]
        got = {r[0]: tuple(r[1:]) for r in matched(terms, wanted, [no] if no else []).collect()}
        want = {}
        for k, t in rows:
            n = [sum(count(u, t) for u in (some if isinstance(some, tuple) else (some,))) for some in wanted]
            if all(n) and not (no and count(no, t)):
                want[k] = tuple(n)
        assert got == want, (a, b, no)
    assert matched(terms, []).count() == 0


def test_ranking_counts_phrases_as_words(corpus):
    rows, (terms, lengths) = corpus
    assert best_matches(terms, lengths, [Phrase("a"), Phrase("c")], 9).collect() == lexical_indexed(terms, lengths, "a c", 9).collect()
    units = [Phrase("a b"), (Prefix("abc"), Phrase("d"))]
    tf = {k: [count(units[0], t), sum(count(u, t) for u in units[1])] for k, t in rows}
    n, mean = len(rows), sum(len(words_of(t)) for _, t in rows) / len(rows)
    df = [sum(bool(v[i]) for v in tf.values()) for i in range(2)]
    idf = [max(math.log((n - d + 0.5) / (d + 0.5)), 0) or 1e-6 for d in df]
    score = {k: sum(idf[i] * v[i] * 2.2 / (v[i] + 1.2 * (0.25 + 0.75 * len(words_of(rows[k][1])) / mean)) for i in range(2)) for k, v in tf.items() if all(v)}
    got = best_matches(terms, lengths, units, 5).collect()
    assert [r.chunk_id for r in got] == [k for k, _ in itertools.islice(sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0])), 5)]
    assert all(abs(r.bm25 - score[r.chunk_id]) < 1e-9 for r in got)


def test_only_the_words_own_postings_are_read(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), 8)
    files = spark.createDataFrame([(f"/{k}.txt", f"slow turtle number{k}", "txt", 0, 0) for k in range(50)], "path string, text string, file_type string, last_modified long, line_offset int")
    index_files(store, files, HashEmbedder(8))
    hits = matched(store.table("postings"), [Phrase("turtle number7"), Prefix("slo")])
    assert hits.join(store.table("chunks"), "chunk_id").select("path").collect() == [("/7.txt",)]
    plan = hits._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(In(term, [number7,turtle]),StringStartsWith(term,slo))]" in plan or "StringStartsWith(term,slo)" in plan
    assert hits.select(F.max("tf0")).first()[0] == 1
