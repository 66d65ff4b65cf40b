import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuskiln.llm import quality, toxicity

from .conftest import text


def labelled(spark, kind, n=900):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        words = text(rng, rng.randint(20, 80)).split()
        bad = rng.random() < 0.25
        if bad and kind == "toxic":
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vileword", "nastyword"])
        if bad and kind == "quality":
            words = [w + rng.choice(["$$$", "&&&"]) for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad) if kind == "toxic" else int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, f"doc_id long, {kind} int"), dict(labels)


def right(rows, truth, held):
    own = [r.predicted == truth[r.doc_id] for r in rows if held(r.doc_id)]
    return sum(own) / len(own)


def test_held_out_toxicity(spark):
    docs, labels, truth = labelled(spark, "toxic")
    rows = toxicity.toxicity(docs, labels).collect()
    assert right(rows, truth, lambda k: zlib.crc32(str(k).encode()) % 4 == 2) > 0.97
    held = {r.doc_id: r.h for r in docs.withColumn("h", toxicity.held_out_rows()).collect()}
    assert all(h == (zlib.crc32(str(k).encode()) % 4 == 2) for k, h in held.items())


def test_held_out_quality(spark):
    docs, labels, truth = labelled(spark, "quality")
    assert right(quality.quality(docs, labels).collect(), truth, lambda k: zlib.crc32(str(k).encode()) % 5 == 0) > 0.97


def test_held_out_labels_are_not_read(spark):
    docs, labels, _ = labelled(spark, "toxic", 300)
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_odd_rows(spark, odd_documents, no_documents):
    for model, name in ((toxicity.toxicity, "toxic"), (quality.quality, "quality")):
        labels = spark.createDataFrame([(i % 30, i % 2, "x") for i in range(60)] + [(None, 1, "x"), (4, None, "x"), (5, 7, "x")], f"doc_id long, {name} int, text string")
        rows = model(odd_documents, labels).collect()
        assert len(rows) == 18 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.source == "src" for r in rows)
        assert {r.score for r in model(odd_documents, labels.limit(0)).collect()} == {0.5}
        assert model(no_documents, labels).count() == 0
        named = model(odd_documents, labels, names=("s2", "p2"))
        assert {r.score for r in named.collect()} == {1.0} and {"s2", "p2"} <= set(named.columns)


def test_interactions_are_learnt():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 3] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    model = quality.Additive(x, y)
    assert (3, 7) in model.pairs and ((model.scores(x) > 0.5) == y).mean() > 0.9


def test_features_do_not_depend_on_neighbours():
    texts = pa.array(["one two two\nthree", None, "", "A!! B!! A!! B!!", "x | y | z"])
    alone = np.concatenate([quality.features(pa.array([t], pa.string())) for t in texts.to_pylist()])
    assert np.allclose(quality.features(texts), alone) and not alone[1].any()


def test_every_shard_is_a_task_of_its_own(spark):
    docs, labels, _ = labelled(spark, "toxic", 400)
    known = labels.withColumnRenamed("toxic", "y")
    for shards in (1, 2, 3, 7):
        rows = toxicity.dealt(docs, known, shards, 2).withColumn("task", F.spark_partition_id())
        tasks = {r.task: (r.kinds, r.n) for r in rows.groupBy("task").agg(F.countDistinct("shard").alias("kinds"), F.count(F.lit(1)).alias("n")).collect()}
        assert len(tasks) == shards and all(k == 1 for k, _ in tasks.values()) and sum(n for _, n in tasks.values()) == 800


def plain_ftrl(rows, l1, base):
    """Weights of one stream of (features, y), a number at a time."""
    z, n = {}, {}

    def weight(i):
        free = l1 if i else 0.0
        if abs(z.get(i, 0.0)) <= free:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * free) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for features, y in rows:
        own = {i: weight(i) for i in {*features, 0}}
        g = 1 / (1 + math.exp(-(base + sum(own.values())))) - y
        for i, w in own.items():
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
            z[i], n[i] = z.get(i, 0.0) + g - sigma * w, n.get(i, 0.0) + g * g
    return {i: (weight(i), n[i]) for i in z if weight(i)}


@pytest.mark.parametrize("shards", [1, 3])
def test_training_is_plain_ftrl(spark, monkeypatch, shards):
    docs, labels, truth = labelled(spark, "toxic", 240)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 240 * 3 // 4 // shards)
    monkeypatch.setattr(toxicity, "L1", 0.5)
    width = 1 << 12
    places, weights = toxicity.fit(docs, labels, toxicity.held_out_rows(), width=width)
    text = {r.doc_id: r.text for r in docs.collect()}
    known = labels.where(~toxicity.held_out_rows()).withColumnRenamed("toxic", "y")
    n, toxic = known.count(), known.where("y = 1").count()
    base = math.log((toxic + 1) / (n - toxic + 1))
    total = {}
    order = [(r.doc_id, r.shard) for r in toxicity.dealt(docs, known, shards, 1).collect()]
    for s in range(shards):
        own = [(next(toxicity._features(pa.array([text[k]]), width)).tolist(), truth[k]) for k, shard in order if shard == s]
        for i, (w, much) in plain_ftrl(own * toxicity.EPOCHS, 0.5 * (n / shards / toxicity.SHARD_ROWS) ** 0.5, base).items():
            total.setdefault(i, []).append((w, much))
    want = {i: sum(w * m for w, m in x) / sum(m for _, m in x) for i, x in total.items()}
    want[0] = want.get(0, 0.0) + base
    got = dict(zip(places.tolist(), weights.tolist(), strict=True))
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i]) for i in want) and len(got) > 20


def plain_additive(x, y):
    """Cyclic boosting by loops: per feature trees of up to two cuts, then per pair trees of one cut each way."""
    n, d = len(x), len(x[0])
    cuts = [sorted(set(np.quantile([r[j] for r in x], np.linspace(0, 1, quality.BINS + 1)[1:-1]).tolist())) for j in range(d)]
    rough = [c[:: max(1, len(c) // 7)][:7] for c in cuts]
    bin_of = lambda c, v: sum(v >= k for k in c)
    bias = math.log((sum(y) + 1) / (n - sum(y) + 1))
    logit = [bias] * n

    def sums(rows):
        p = [1 / (1 + math.exp(-logit[i])) for i in rows]
        return sum(y[i] - q for i, q in zip(rows, p, strict=True)), sum(q * (1 - q) for q in p)

    gain = lambda rows: (lambda g, h: g * g / (h + 1))(*sums(rows))
    value = lambda rows: (lambda g, h: g / (h + 1))(*sums(rows))

    def fit_feature(j):
        rows_in = [[i for i in range(n) if bin_of(cuts[j], x[i][j]) == b] for b in range(len(cuts[j]) + 1)]
        flat = lambda a, b: [i for bin in rows_in[a:b] for i in bin]
        parts = [(0, len(rows_in))]
        while len(parts) < 3:
            options = [(gain(flat(a, c)) + gain(flat(c, b)) - gain(flat(a, b)), -k, -c) for k, (a, b) in enumerate(parts) for c in range(a + 1, b)]
            best = max(options, default=None)
            if best is None or best[0] <= 1e-12:
                break
            a, b = parts.pop(-best[1])
            parts += [(a, -best[2]), (-best[2], b)]
        return [(flat(a, b), value(flat(a, b))) for a, b in parts]

    def fit_pair(i, j):
        cell = [(bin_of(rough[i], r[i]), bin_of(rough[j], r[j])) for r in x]
        quarters = lambda a, b: [[k for k in range(n) if (cell[k][0] <= a) == up and (cell[k][1] <= b) == left] for up in (True, False) for left in (True, False)]
        _, _, _, best = max((round(sum(map(gain, quarters(a, b))), 9), -a, -b, (a, b)) for a in range(7) for b in range(7))
        return [(q, value(q)) for q in quarters(*best)]

    def push(steps):
        for rows, v in steps:
            for i in rows:
                logit[i] += quality.RATE * v

    for _ in range(quality.ROUNDS):
        for j in range(d):
            push(fit_feature(j))
    gains = {}
    for i in range(d):
        for j in range(i + 1, d):
            cells = {}
            for k in range(n):
                cells.setdefault((bin_of(rough[i], x[k][i]), bin_of(rough[j], x[k][j])), []).append(k)
            gains[i, j] = sum((lambda g, h: g * g / (h + 5))(*sums(rows)) for rows in cells.values())
    for _ in range(quality.PAIR_ROUNDS):
        for i, j in sorted(gains, key=lambda k: -gains[k])[: quality.PAIRS]:
            push(fit_pair(i, j))
    return [1 / (1 + math.exp(-v)) for v in logit]


def test_boosting_is_plain_boosting(monkeypatch):
    for name, value in (("ROUNDS", 3), ("PAIR_ROUNDS", 2), ("PAIRS", 2), ("BINS", 10)):
        monkeypatch.setattr(quality, name, value)
    rng = np.random.default_rng(4)
    x = rng.random((60, 3))
    y = ((x[:, 0] > 0.4) ^ (x[:, 1] > 0.6) | (rng.random(60) < 0.1)).astype(float)
    assert np.allclose(quality.Additive(x, y).scores(x), plain_additive(x.tolist(), y.tolist()))
