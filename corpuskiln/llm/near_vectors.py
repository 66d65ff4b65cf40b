"""Near-duplicate embeddings by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, drop, for_salts, hot_keys, local_roots, salted

#: Rows of a neighbour window, of a block of a long run; windows of a task's stretch; bits that order rows within a run.
WINDOW, BLOCK, STRETCH, DEEPER, MISS, SEED = 128, 2048, 16, 16, 1e-3, 20240607


def _rows(column: pa.Array) -> list[np.ndarray]:
    """The vectors of a list column as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    return np.split(flat, ends[:-1])


def _codes(passes: int, bits: int):
    """Adds per row one integer for each pass: `bits` random hashes (signs of projections), concatenated."""
    weights = 1 << np.arange(bits)[::-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = _rows(batch.column("embedding"))
            sizes = np.array([len(r) for r in rows], np.int64)
            codes = np.zeros((len(rows), passes), np.int64)
            for d in np.unique(sizes):
                if d not in planes:
                    planes[d] = np.random.default_rng([SEED, int(d)]).standard_normal((d, passes * bits))
                at = np.flatnonzero(sizes == d)
                x = np.stack([rows[i] for i in at])
                signs = (x / np.abs(x).max(1, keepdims=True)) @ planes[d] > 0
                codes[at] = signs.reshape(len(at), passes, bits) @ weights
            flat = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), passes).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), flat], [*batch.schema.names, "dim", "codes"])

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of the sorted partition and each row's place in it."""
    part, place = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(np.arange(place, place + n))], [*batch.schema.names, "partition", "place"])
        place += n


class _Cell:
    """Rows that are compared inside one task, with where they stand in every pass."""

    def __init__(self, cell: pa.Table, threshold: float) -> None:
        cell = cell.combine_chunks()
        column = lambda c: cell.column(c).chunk(0)
        self.threshold, self.turn = threshold, cell.column("turn")[0].as_py()
        self.ids, self.copies = (column(c).to_numpy().astype(np.int64) for c in ("rep", "copies"))
        n = len(self.ids)
        label = column("label").dictionary_encode().indices.to_numpy().astype(np.int64)
        rows = _rows(column("embedding"))
        size = np.array([len(r) for r in rows])
        self.kind = label * (size.max() + 1) + size
        self.x = np.zeros((n, size.max()))
        for i, row in enumerate(rows):
            self.x[i, : len(row)] = row / np.abs(row).max()
        self.norm = np.sqrt((self.x * self.x).sum(1))
        self.runs, self.blocks = (column(c).flatten().to_numpy().reshape(n, -1) for c in ("runs", "blocks"))
        self.size = column("size").to_numpy()
        self.near, self.links = np.zeros((n, n), bool), np.zeros(n, np.int64)

    def compare(self, a: np.ndarray, b: np.ndarray, take) -> None:
        """Links the rows a with the rows b (equal or disjoint) that no earlier pass has compared; take: which
        pairs are this cell's."""
        linked = (self.x[a] @ self.x[b].T) / np.outer(self.norm[a], self.norm[b]) >= self.threshold
        linked &= (self.kind[a][:, None] == self.kind[b][None, :]) & (self.ids[a][:, None] != self.ids[b][None, :])
        i, j = np.nonzero(linked)
        i, j = a[i], b[j]
        new = take(self, i, j)
        for t in range(self.turn):
            new &= ~((self.runs[i, t] == self.runs[j, t]) | (np.abs(self.blocks[i, t] - self.blocks[j, t]) <= 1))
        i, j = i[new], j[new]
        self.near[i, j] = self.near[j, i] = True
        np.add.at(self.links, i, self.copies[j])
        if len(a) and len(b) and a[0] != b[0]:
            np.add.at(self.links, j, self.copies[i])

    def found(self) -> pa.Table:
        some = np.flatnonzero(self.near.any(1))
        roots = local_roots(self.near[np.ix_(some, some)], self.ids[some])
        return pa.table([pa.array(self.ids[some]), pa.array(self.links[some]), pa.array(roots)], names=["rep", "links", "root"])


def _compare_windows(threshold: float, window: int):
    """A stretch of the sorted order: every block of `window` rows with itself and with the next one."""

    def ours(cell: _Cell, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return ~((cell.runs[i, cell.turn] == cell.runs[j, cell.turn]) & (cell.size[i] > window))

    def run(table: pa.Table) -> pa.Table:
        cell = _Cell(table, threshold)
        block, last = cell.blocks[:, cell.turn], (table.column("stretch")[0].as_py() + 1) * STRETCH
        for k in np.unique(block[block < last]):
            own = np.flatnonzero(block == k)
            cell.compare(own, own, ours)
            cell.compare(own, np.flatnonzero(block == k + 1), ours)
        return cell.found()

    return run


def _not_met(cell: _Cell, left: np.ndarray, right: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, as products of sets, without those that the largest earlier run among them has compared: of a group of near copies, which is one
    run in most passes, only the rows that weren't in it are compared again. left and right are equal or disjoint."""
    same, met = left is right, np.zeros(len(cell.ids), bool)
    both = left if same else np.append(left, right)
    for t in range(cell.turn):
        runs, place, often = np.unique(cell.runs[both, t], return_inverse=True, return_counts=True)
        if often.max() > met.sum():
            met[:] = False
            met[both[place == often.argmax()]] = True
    others, again = left[~met[left]], left[met[left]]
    pairs = [(others, others), (others, again)] if same else [(others, right), (again, right[~met[right]])]
    return [(a, b) for a, b in pairs if len(a) and len(b)]


def _compare_run(threshold: float):
    """Two blocks of a run that is longer than a window (or one with itself)."""

    def ours(cell: _Cell, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return cell.runs[i, cell.turn] == cell.runs[j, cell.turn]

    def run(table: pa.Table) -> pa.Table:
        cell = _Cell(table, threshold)
        low, high = (table.column(c)[0].as_py() for c in ("low", "high"))
        part = table.column("part").to_numpy()
        left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
        for a, b in _not_met(cell, left, left if low == high else right):
            if a is b:
                cell.compare(a, b, ours)
            else:
                for at in range(0, len(a), 256):
                    cell.compare(a[at : at + 256], b, ours)
        return cell.found()

    return run


_LINKED = "rep long, links long, root long"


def near_vectors(embeddings: DataFrame, threshold: float = 0.93, window: int = WINDOW, block: int = BLOCK, miss: float = MISS) -> DataFrame:
    """Links vectors of equal label whose cosine in double precision is at least `threshold`.

    Returns per vector vec_id, n_links, component_id (the smallest vec_id reachable by links) and
    kept (vec_id = component_id).

    Equal vectors of a label fall together first. Every pass orders the rest lexicographically by label and by
    concatenated random hashes of its own (signs of projections): a range sort of ids and hashes. The sorted order is cut
    into blocks of `window` rows; a row is compared with its own block and the next one, across the
    sort's partitions, so with all rows up to `window` places away. Links that pass are united over all
    passes. Rows whose first hashes are equal form a run, of about `window` rows; one that is longer than a window (a large group
    of close vectors) is also compared whole, in pairs of blocks that are tasks of their own, so
    no group is capped. The passes are as many as leave a pair at the threshold without a common run
    with chance `miss`; closer pairs, and neighbours over a run's edge, meet more surely. Rows carry their
    runs and blocks of all passes, so a pair counts only in the first pass that compares it, and of a long run only the rows outside its largest
    earlier run are compared again; what leaves a
    task is one row for each linked vector: its new links and the root of its local group.

    Vectors that are null, empty, all zero or hold null or non-finite components, and rows without a
    label, link with nothing. Vectors of different lengths never link. Rows that repeat a vec_id fall
    together (the smallest label and vector count); a null vec_id gives a row with component_id null
    and kept true. Other columns aren't read. An empty table gives an empty result.
    """
    named = embeddings.select(F.col("vec_id").cast("long"), F.col("label"), F.col("embedding"))
    rows = named.where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r")).select("vec_id", "r.*")
    sound = F.expr("label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)")
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    rows = cut(rows.withColumn("k1", F.xxhash64("label", "embedding")).withColumn("k2", F.xxhash64(F.lit(SEED), "embedding", "label")), "vectors")
    classes = rows.where("sound").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = cut(classes, "vclasses")
    largest = rows.where("sound").groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(largest / window))) if largest else 0
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    passes = 1 if meet == 1 else math.ceil(math.log(miss) / math.log(1 - meet))

    one = rows.where("sound").join(classes.where("copies > 1").select("k1", "k2", "rep", "copies"), ["k1", "k2"], "left").where("rep is null or rep = vec_id")
    one = one.select(F.col("vec_id").alias("rep"), "label", "embedding", F.coalesce("copies", F.lit(1)).alias("copies"))
    kind = {c: one.schema[c].dataType.simpleString() for c in ("label", "embedding")}
    schema = f"rep long, label {kind['label']}, embedding {kind['embedding']}, copies long, dim long, codes array<long>"
    coded = cut(one.mapInArrow(_codes(passes, bits + DEEPER), schema), "coded")

    order = ["turn", "label", "dim", "code", "rep"]
    keys = coded.select("label", "dim", "rep", F.posexplode("codes").alias("turn", "code")).withColumn("run", F.xxhash64("turn", "label", "dim", F.shiftright("code", DEEPER)))
    placed = keys.select("run", *order).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.mapInArrow(_placed, f"run long, turn int, label {kind['label']}, dim long, code long, rep long, partition int, place long"), "placed")
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("partition").agg(F.count(F.lit(1)).alias("n")).select("partition", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # One row for each partition of the sort.
    at = placed.join(F.broadcast(starts), "partition").select("turn", "rep", "run", F.floor((F.col("start") + F.col("place")) / window).alias("block"))
    sizes = cut(placed.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > window), "sizes")
    hot = hot_keys(sizes, "run")
    at = salted(at, hot, "run", "rep").join(for_salts(sizes, hot, "run"), ["run", "salt"], "left")
    stands = at.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("turn", "run", "block", F.coalesce("n", F.lit(0)).alias("size")))).alias("s"))
    stands = stands.select("rep", F.col("s.run").alias("runs"), F.col("s.block").alias("blocks"), F.col("s.size").alias("sizes"))
    each = cut(coded.drop("codes", "dim").join(stands, "rep"), "stands").select("*", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("turn"))
    # A pass needs to know of itself and of those before.
    upto = lambda c: F.slice(c, F.lit(1), F.col("turn") + 1).alias(c)
    each = each.select("rep", "label", "embedding", "copies", "turn", upto("runs"), upto("blocks"), F.col("sizes")[F.col("turn")].alias("size"))

    own, size = F.col("blocks")[F.col("turn")], F.col("size")
    stretch = F.floor(own / STRETCH)
    # A stretch's first block is the last neighbour of the stretch before.
    stretches = each.withColumn("stretch", F.explode(F.when(own % STRETCH == 0, F.array(stretch - 1, stretch)).otherwise(F.array(stretch))))
    windows = stretches.groupBy("turn", "stretch").applyInArrow(_compare_windows(threshold, window), _LINKED)
    parts = F.ceil(size / block).cast("int")
    long = each.where(size > window).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    long = long.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("run", F.col("runs")[F.col("turn")])
    long = long.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
    whole = long.groupBy("turn", "run", "low", "high").applyInArrow(_compare_run(threshold), _LINKED)
    linked = cut(windows.unionByName(whole), "linked")
    for old in (coded, placed, sizes):
        drop(old)

    found = components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = linked.groupBy("rep").agg(F.sum("links").alias("links")).join(found, F.col("rep") == F.col("node"), "left").select("rep", "links", "component")
    out = rows.join(classes.select("k1", "k2", F.col("rep").alias("crep"), "copies"), ["k1", "k2"], "left").join(counts, F.col("crep") == F.col("rep"), "left")
    links = F.when(F.col("sound"), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0).cast("long")
    own = F.when(F.col("sound"), F.coalesce("component", "crep")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", links.alias("n_links"), own.alias("component_id"))
    nameless = named.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(nameless).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
