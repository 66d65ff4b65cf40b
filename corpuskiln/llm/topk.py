"""Exact top-k inner-product search: a ball tree per shard, branch and bound."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard: few enough for every core to have one, at most what a task can hold.
LEAST_SHARD, MOST_SHARD, LEAF, BLOCK = 4096, 65536, 256, 256
#: Whole numbers below EXACT are doubles without rounding; vectors with components from WIDE on have trees of their own.
EXACT, WIDE = 2**53, 2**20


class BallTree:
    """Nodes over vectors of whole numbers: each halves its rows along the line between two far rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> None:
        order = np.lexsort((ids,))
        self.rows, self.ids, self.x = np.arange(len(ids)), ids[order], x[order]
        self.nodes: list[tuple[int, int, int, int]] = []  # first row, end, left child, right child
        with np.errstate(over="ignore", invalid="ignore"):
            self._grow(0, len(ids), leaf)
            self.ids, self.x = self.ids[self.rows], self.x[self.rows]
            spans = [self.x[a:b] for a, b, _, _ in self.nodes]
            self.centres = np.array([s.mean(0) for s in spans])
            self.radii = np.array([np.sqrt(((s - c) ** 2).sum(1).max()) for s, c in zip(spans, self.centres, strict=True)])
        self.largest = np.abs(self.x).max(initial=0)

    def _grow(self, a: int, b: int, leaf: int) -> int:
        me = len(self.nodes)
        self.nodes.append((a, b, -1, -1))
        if b - a > leaf:
            own = self.x[self.rows[a:b]]
            far = own[((own - own[0]) ** 2).sum(1).argmax()]
            other = own[((own - far) ** 2).sum(1).argmax()]
            self.rows[a:b] = self.rows[a:b][np.argsort(own @ (far - other), kind="stable")]
            middle = (a + b) // 2
            self.nodes[me] = (a, b, self._grow(a, middle, leaf), self._grow(middle, b, leaf))
        return me

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No row of a node has a larger inner product than q.c + |q| r, with room for rounding."""
        with np.errstate(over="ignore", invalid="ignore"):
            long = np.sqrt((queries**2).sum(1))[:, None]
            reach = np.sqrt((self.centres**2).sum(1)) + self.radii
            out = queries @ self.centres.T + long * self.radii + 1e-9 * (1 + long * reach)
        return np.where(np.isnan(out), np.inf, out)

    def search(self, own: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> list[tuple[np.ndarray, list[int] | np.ndarray]]:
        """Per query its up to k best (ids, scores) of at least its floor, other than its own id.

        Nodes wait in order of the largest bound that any query still has for them. A query's k-th score
        so far, which starts at the floor found in another shard, takes it out of nodes that it can't
        reach; nodes that equal it are still opened, so ties are complete. A leaf is one matrix product
        with the queries that are left.
        """
        exact = self.largest * np.abs(queries).sum(1) < EXACT
        out: list = [(np.zeros(0, np.int64), np.zeros(0))] * len(own)
        for i in np.flatnonzero(~exact):
            out[i] = self._search_wide(own[i], queries[i], floors[i], k)
        some = np.flatnonzero(exact)
        bounds, kth = self.bounds(queries), floors.astype(np.float64).copy()
        heap = [(-bounds[some, 0].max(initial=-np.inf), 0, some)]
        while heap:
            _, node, some = heapq.heappop(heap)
            some = some[bounds[some, node] >= kth[some]]
            if not len(some):
                continue
            a, b, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    heapq.heappush(heap, (-bounds[some, child].max(), child, some))
                continue
            got = self.x[a:b] @ queries[some].T
            good = (got >= kth[some]) & (self.ids[a:b, None] != own[some])
            for j in np.flatnonzero(good.any(0)):
                i, rows = some[j], good[:, j]
                ids, scores = np.append(out[i][0], self.ids[a:b][rows]), np.append(out[i][1], got[rows, j])
                best = np.lexsort((ids, -scores))[:k]
                out[i] = ids[best], scores[best]
                if len(best) == k:
                    kth[i] = max(kth[i], scores[best[-1]])
        return out

    def _search_wide(self, own: int, query: np.ndarray, floor: float, k: int) -> tuple[np.ndarray, list[int]]:
        """The same for one query whose sums doubles may round: with Python's integers."""
        bound, q = self.bounds(query[None])[0], [int(v) for v in query.tolist()]
        heap, best, kth = [(-bound[0], 0)], [], floor
        while heap and -heap[0][0] >= kth:
            a, b, left, right = self.nodes[heapq.heappop(heap)[1]]
            if left >= 0:
                for child in (left, right):
                    heapq.heappush(heap, (-bound[child], child))
                continue
            for i, row in zip(self.ids[a:b].tolist(), self.x[a:b].tolist(), strict=True):
                score = sum(int(v) * w for v, w in zip(row, q, strict=True))
                if score >= kth and i != own:
                    best.append((-score, i))
            best = sorted(best)[:k]
            if len(best) == k:
                kth = max(kth, -best[-1][0])
        return np.array([i for _, i in best], np.int64), [-s for s, _ in best]


def _as_double(score: int) -> float:
    try:
        return float(score)
    except OverflowError:
        return math.inf if score > 0 else -math.inf


def sort_key(score: int) -> str:
    """Text in the order of the numbers, for those that doubles may round; empty for others."""
    if abs(score) < EXACT:
        return ""
    digits = str(abs(score))
    key = f"{len(digits):04d}{digits}"
    return "1" + key if score > 0 else "0" + key.translate(str.maketrans("0123456789", "9876543210"))


_FOUND = "query_id long, vec_id long, score double, key string, whole long, found int"


def _found(query_ids: list[int], answers: list) -> pa.RecordBatch:
    """One row for each hit. score is the double nearest to it, key tells scores of one double apart, whole
    is the score as a long (the nearest there is)."""
    sizes = [len(ids) for ids, _ in answers]
    scores = [s for _, own in answers for s in (own if isinstance(own, list) else own.tolist())]
    whole = [min(max(int(s), -(2**63)), 2**63 - 1) for s in scores]
    columns = [
        pa.array(np.repeat(np.array(query_ids, np.int64), sizes)), pa.array(np.concatenate([np.zeros(0, np.int64), *(ids for ids, _ in answers)])), pa.array([_as_double(s) for s in scores], pa.float64()),
        pa.array([sort_key(s) if isinstance(s, int) else "" for s in scores], pa.string()), pa.array(whole, pa.int64()), pa.array(np.repeat(sizes, sizes).astype(np.int32)),
    ]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _FOUND.split(", ")])


def _merged(first: tuple, second: tuple, k: int) -> tuple:
    pairs = sorted((-s, i) for ids, scores in (first, second) for i, s in zip(ids.tolist(), map(int, scores), strict=True))[:k]
    return np.array([i for _, i in pairs], np.int64), [-s for s, _ in pairs]


def _search_shards(k: int):
    """Streams a partition ordered by (shard, dim, kind): a shard's rows, then its queries in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, trees = None, [], []
        for batch in batches:
            shard, dim, kind, own, floor = (batch.column(c).to_numpy() for c in ("shard", "dim", "kind", "vec_id", "floor"))
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            ends = np.append(0, np.cumsum(dim.astype(np.int64)))
            change = np.flatnonzero(np.diff(shard) | np.diff(dim) | np.diff(kind)) + 1
            for a, b in zip([0, *change], [*change, len(own)], strict=True):
                if a == b:
                    continue
                if (shard[a], dim[a]) != key:
                    key, rows, trees = (shard[a], dim[a]), [], []
                x = flat[ends[a] : ends[b]].reshape(b - a, dim[a])
                if kind[a] == 0:
                    rows.append((own[a:b].copy(), x.copy()))
                    continue
                if rows:
                    ids, held = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
                    wide = np.abs(held).max(1, initial=0) >= WIDE
                    trees, rows = [BallTree(ids[w], held[w]) for w in (~wide, wide) if w.any()], []
                for i in range(a, b, BLOCK):
                    j = min(b, i + BLOCK)
                    answers = [t.search(own[i:j], x[i - a : j - a], floor[i:j], k) for t in trees]
                    if len(answers) == 2:
                        answers = [[_merged(p, q, k) for p, q in zip(*answers, strict=True)]]
                    if answers:
                        yield _found(own[i:j].tolist(), answers[0])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int | None = None) -> DataFrame:
    """The k rows of `vectors` with the largest inner product for each row of `queries`.

    Both have vec_id and vector (whole numbers as array<double> or array<long>; a null vector, null
    component or null vec_id takes no part). Returns query_id, rank (from 1), vec_id and score, ties to the smaller
    vec_id; fewer than k rows where there are fewer candidates; never a row with the query's own id.
    Vectors of another length than the query's aren't candidates. Rows that repeat a vec_id are
    candidates each; of a repeated query id the smallest vector counts. Scores and their order are
    exact at every size of the components that a double holds; a score beyond a long is given as the nearest long.

    Rows are dealt to shards of `shard_rows`, each with its own ball tree. First every query
    searches one shard; the k-th score found there is the floor that its searches of all other
    shards start from. How many nodes that leaves unopened depends on the data: on vectors without
    clusters all are opened, and a leaf is then a matrix product with a block of queries. A query goes to every shard,
    so its vector is shuffled once for each: shards are as large as a task can hold once every core
    has some. A query leaves at most k rows in a shard. Memory in a task is one shard and one block of queries.
    """
    whole = lambda c: F.col(c).cast("array<double>")
    sound = lambda df: df.where("vec_id is not null and vector is not null and not exists(vector, x -> x is null)")
    rows = sound(vectors).select(F.col("vec_id").cast("long"), whole("vector").alias("vector"))
    asked = sound(queries).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(whole("vector")).alias("vector"))
    n, cores = rows.count(), vectors.sparkSession.sparkContext.defaultParallelism
    shards = max(1, math.ceil(n / (shard_rows or min(max(n / (2 * cores), LEAST_SHARD), MOST_SHARD))))
    shard = lambda c: F.pmod(F.xxhash64(c, F.lit(17)), F.lit(shards)).cast("int")
    held = rows.select(shard("vec_id").alias("shard"), F.size("vector").alias("dim"), F.lit(0).alias("kind"), "vec_id", "vector", F.lit(0.0).alias("floor"))
    asks = lambda q, at, floor: q.select(at.alias("shard"), F.size("vector").alias("dim"), F.lit(1).alias("kind"), "vec_id", "vector", floor.alias("floor"))

    def search(q: DataFrame) -> DataFrame:
        dealt = held.unionByName(q).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "dim", "kind", "vec_id")
        return dealt.mapInArrow(_search_shards(k), _FOUND)

    none = F.lit(float("-inf"))
    home = search(asks(asked, shard("vec_id"), none))
    if shards == 1:
        found = home
    else:
        kth = F.min("score")
        # A double that may have been rounded up isn't a floor yet.
        below = F.when(F.abs(kth) < EXACT, kth).when(F.abs(kth) == F.lit(float("inf")), none).otherwise(kth - F.abs(kth) * 1e-12)
        floors = home.where(F.col("found") == k).groupBy("query_id").agg(below.alias("floor"))
        known = asked.join(floors, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "vector", F.coalesce("floor", none).alias("floor"))
        others = known.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("at") != shard("vec_id"))
        found = home.unionByName(search(asks(others, F.col("at"), F.col("floor"))))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("key"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", F.col("whole").alias("score"))


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector: floor(64 * x) of every component as a double, which is exact; null where any component
    is null, not finite, or (doubles beyond 2^1018 only) has no finite 64-fold."""
    sound = F.expr("embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(64D * cast(x as double)) < double('inf'))")
    # floor() of a double is a bigint, which ends at 2^63; from 2^53 on doubles are whole already.
    vector = F.expr("transform(transform(embedding, x -> 64D * cast(x as double)), y -> if(abs(y) < 9007199254740992D, cast(floor(y) as double), y))")
    return embeddings.select(F.col("vec_id").cast("long"), F.when(sound, vector).alias("vector"))
