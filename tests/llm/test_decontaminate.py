"""Decontamination against plain loops over windows."""

import random
import re

import pytest

from corpuskiln.llm.decontaminate import contamination

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(documents, benchmark, window=10):
    kept = {}
    for item, text in benchmark:
        w = words_of(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            kept.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in documents:
        w, hit, items = words_of(text), set(), set()
        for n in {len(k) for k in kept}:
            for i in range(len(w) - n + 1):
                if (found := kept.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    items |= found - {None}
        out.append((doc, len(w), frozenset(hit), tuple(sorted(map(str, items)))))
    return sorted(out, key=repr)


def of_spark(rows):
    for r in rows:
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
    return sorted([(r.doc_id, r.n_words, frozenset(p for s in r.spans for p in range(s.start, s.end)), tuple(r["items"])) for r in rows], key=repr)


@pytest.mark.parametrize(("window", "shingle", "seed"), [(10, 5, 1), (4, 4, 2), (6, 1, 3), (7, 3, 4)])
def test_same_as_loops(spark, window, shingle, seed):
    rng = random.Random(seed)
    some = lambda n: " ".join(rng.choices("a b c The dé 日本 x1".split(), k=n))
    items = [(i, some(rng.choice([1, 2, 5, 9, 10, 11, 30]))) for i in range(6, 12)] + [(7, some(12)), (None, some(14)), (90, None), (91, " .,;"), (100, "a a a a a a a a a a a a")]
    texts = [some(rng.choice([0, 1, 9, 10, 60])) for _ in range(25)] + [None, "", " \n"]
    texts += [some(5) + " " + t.upper().replace(" ", ", ") + "! " + some(5) for _, t in items if t]
    docs = [(i // 2, t) for i, t in enumerate(texts)] + [(None, texts[-1]), (3, texts[-1]), (3, texts[-1]), (500, " ".join(["a"] * 5000)), (501, some(20000))]
    got = contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), window, shingle).collect()
    assert of_spark(got) == brute(docs, items, window)


def test_odd_rows(spark, odd_documents, no_documents):
    items = spark.createDataFrame([(1, "one two", "t", 1), (2, "nameless TEXT", "t", 2)], ITEMS + ", key string, window int")
    docs = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert of_spark(contamination(odd_documents, items).collect()) == brute(docs, [(1, "one two"), (2, "nameless TEXT")])
    assert contamination(no_documents, items).count() == 0
    got = contamination(odd_documents, items.limit(0)).collect()
    assert len(got) == len(docs) and not any(r.spans or r["items"] for r in got)
    with pytest.raises(ValueError, match="windows"):
        contamination(odd_documents, items, 3, 4)
