"""Spelling variants against plain loops."""

import random
import re
import zlib
from collections import Counter

import pytest

from corpuskiln.llm.spelling import near_pairs, spelling_variants, word_counts

DOCS = "doc_id long, text string"


def counted(docs, least_length, least_count, one_in):
    total = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if one_in and h % one_in == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            total[word] += len(word) >= least_length
    return {w: n for w, n in total.items() if n >= least_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=5):
    close = {w: [x for x in counts if near(w, x)] for w in counts}
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(close[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("letters", ["ab", "abé", "aàâäbcÿ÷", "abcdefghijklmnopqrstuvwxyz"])
def test_pairs(spark, letters):
    rng = random.Random(len(letters))
    words = {"".join(rng.choices(letters, k=rng.randint(4, 9))) for _ in range(150)}
    for w in list(words):
        at = rng.randrange(len(w))
        words |= {w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]}
    words = sorted(w for w in words if len(w) >= 4) + [letters[0] * 300, letters[0] * 301, letters[0] * 150 + letters[1] + letters[0] * 150]
    got = near_pairs(spark.createDataFrame([(w,) for w in [*words, "ab"]], "word string")).collect()
    assert sorted(map(tuple, got)) == [(a, b) for i, a in enumerate(sorted(words)) for b in sorted(words)[i + 1 :] if near(a, b)]


def test_documents(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choices("abcdeéÿ", k=rng.randint(5, 8))) for _ in range(12)]
    docs = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 80)):
            w = stems[min(int(rng.expovariate(0.5)), 11)]
            words.append(w if rng.random() < 0.8 else w[:3] + rng.choice("abÉX") + w[3 + rng.randint(0, 1) :])
        docs.append((rng.choice([i, 7, None]), rng.choice([" ", "-", "日", "0", " Ÿ"]).join(words)))
    docs += [(3, None), (4, ""), (5, " .")] + docs[:4]
    for length, least, one_in in ((6, 5, 7), (4, 1, 1), (5, 2, None)):
        counts = word_counts(spark.createDataFrame(docs, DOCS), length, least, one_in)
        want = counted(docs, length, least, one_in)
        assert {r.word: r.n for r in counts.collect()} == want
        assert sorted(map(tuple, spelling_variants(counts).collect()), key=lambda r: r[0]) == brute(want)


def test_chains_and_ties(spark):
    counts = {"abcdef": 1, "abcdeg": 5, "abcdfg": 5, "abcdgg": 25, "abcegg": 130, "abdegg": 700, "zzzzzz": 3, "zzzzzy": 14, "zzzzzx": 15, "zzzzzw": 15}
    rows = [(w, n, "x", 1) for w, n in counts.items()] + [(None, 9, "x", 1)]
    got = spelling_variants(spark.createDataFrame(rows, "word string, n long, form string, near long")).collect()
    assert sorted(map(tuple, got)) == brute(counts)


def test_odd_rows(spark, odd_documents, no_documents):
    docs = [(r.doc_id, r.text) for r in odd_documents.collect()]
    counts = word_counts(odd_documents, 4, 2, 3)
    want = counted(docs, 4, 2, 3)
    assert {r.word: r.n for r in counts.collect()} == want
    assert sorted(map(tuple, spelling_variants(counts).collect())) == brute(want)
    assert spelling_variants(word_counts(no_documents)).count() == 0
