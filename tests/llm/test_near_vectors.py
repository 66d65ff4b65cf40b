import math

import numpy as np
import pyarrow as pa

from corpuskiln.llm import near_vectors as nv
from corpuskiln.llm.near_vectors import near_vectors

SCHEMA = "vec_id long, label int, embedding array<float>, code string, rep int"


def brute(rows, threshold=0.93):
    links = {k: set() for k, *_ in rows}
    for k, label, v in rows:
        for m, other, w in rows:
            if k != m and label is not None and label == other:
                a, b = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[k].add(m)
    out = {}
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            for m in links[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        out[k] = (len(links[k]), min(seen))
    return out


def test_same_as_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for label in (0, 1, None):
        for _ in range(12):
            centre = rng.standard_normal(16)
            rows += [(len(rows) + i, label, (centre + 0.12 * rng.standard_normal(16)).tolist()) for i in range(8)]
    rows += [(1000 + i, 1, rows[110][2]) for i in range(5)]
    frame = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)
    for window, block in ((512, 2048), (16, 2048), (16, 6)):
        got = near_vectors(frame, window=window, block=block, miss=1e-5).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_recall_at_the_default_settings(spark):
    """Pairs of close vectors among 1500 of one label, at the threshold and above, with the production parameters."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(500):
        centre = rng.standard_normal(32)
        rows += [(3 * i + k, 1, (centre + 0.25 * rng.standard_normal(32)).tolist()) for k in range(3)]
    x = np.array([r[2] for r in rows], np.float32).astype(float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    cosine = x @ x.T
    np.fill_diagonal(cosine, 0)
    want = (cosine >= 0.93).sum(1)
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)).collect()}
    links = np.array([got[r[0]] for r in rows])
    near = ((cosine >= 0.93) & (cosine < 0.945)).sum()
    assert (links <= want).all() and want.sum() > 600 and near > 200
    assert links.sum() >= want.sum() - 0.001 * near - 4


def test_a_group_far_larger_than_a_window(spark):
    rng = np.random.default_rng(7)
    centre = rng.standard_normal(16)
    rows = [(i, 0, (centre + 0.08 * rng.standard_normal(16)).tolist()) for i in range(400)] + [(400 + i, 0, rng.standard_normal(16).tolist()) for i in range(200)]
    got = near_vectors(spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA), window=16, block=64, miss=1e-5).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)


def test_a_group_that_stays_together_is_compared_once(spark, monkeypatch):
    """20,000 near copies in ten blocks and three passes; a few rows fall out of the group's run in each."""
    rng = np.random.default_rng(8)
    n, size, passes = 20_000, 2000, 3
    out = [rng.choice(n, 20, replace=False) for _ in range(passes)]
    runs = np.array([[-1 - i * passes - t if i in set(out[t].tolist()) else 7 + t for t in range(passes)] for i in range(n)])
    compared = np.zeros(passes, np.int64)

    def count(cell, a, b, take):
        compared[cell.turn] += len(a) * (len(a) + 1) // 2 if len(a) == len(b) and (a == b).all() else len(a) * len(b)

    monkeypatch.setattr(nv._Cell, "compare", count)
    for t in range(passes):
        own = np.flatnonzero(runs[:, t] == 7 + t)
        for low in range(n // size):
            for high in range(low, n // size):
                rows = own[np.isin(own // size, [low, high])]
                table = {"rep": rows, "copies": np.ones(len(rows), np.int64), "label": np.zeros(len(rows), np.int64), "embedding": [[1.0]] * len(rows), "runs": list(runs[rows, : t + 1]), "blocks": list(np.zeros((len(rows), t + 1), np.int64))}
                table |= {"size": np.full(len(rows), len(own)), "turn": np.full(len(rows), t), "low": np.full(len(rows), low), "high": np.full(len(rows), high), "part": rows // size}
                nv._compare_run(0.93)(pa.table(table))
    assert compared[0] == (n - 20) * (n - 19) // 2
    assert compared[1:].max() <= 20 * n


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, None), (2, 0, []), (3, 0, [0.0, 0.0]), (4, 0, [nan, 1.0]), (5, 0, [inf, 1.0]), (6, 0, [None, 1.0]), (7, None, [1.0, 0.0]), (8, 0, [1.0, 0.0]), (9, 0, [2.0, 0.0]), (9, 0, [2.0, 0.0]), (10, 0, [1.0, 0.0, 0.0]), (None, 0, [1.0, 0.0]), (11, 0, [1e30, 0.0])]
    got = near_vectors(spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)).collect()
    by = {r.vec_id: (r.n_links, r.component_id) for r in got}
    assert len(got) == 12 and by[None] == (0, None)
    assert all(by[k] == (0, k) for k in (1, 2, 3, 4, 5, 6, 7, 10))
    assert by[8] == (2, 8) and by[9] == (2, 8) and by[11] == (2, 8)
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
