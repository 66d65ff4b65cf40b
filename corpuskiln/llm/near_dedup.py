"""MinHash near-duplicate removal with links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop, for_salts, hot_keys, local_roots
from .words import groups, mix, shingle_sets

_U = np.uint64
BANDS, ROWS, STAR_ROUNDS, BLOCK = 32, 6, 2, 1024


def one_permutation_sketch(shingles: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation minima, each empty bin filled by optimal densification.

    One hash per element: its high part picks the bin, the bin keeps the smallest. An empty bin
    copies the bin that a hash of (bin, attempt) picks, trying again while that one is empty, so two
    sets with similarity J agree in any bin with probability J.
    """
    h = mix(shingles ^ _U(0x5851F42D4C957F2D))
    where = ((h >> _U(32)) * _U(bins)) >> _U(32)
    full = np.full(bins, np.iinfo(_U).max, _U)
    np.minimum.at(full, where.astype(np.int64), h)
    used = np.zeros(bins, bool)
    used[where.astype(np.int64)] = True
    todo, attempt = np.flatnonzero(~used), 1
    while len(todo):
        pick = (mix(todo.astype(_U) * _U(1 << 32) + _U(attempt)) % _U(bins)).astype(np.int64)
        good = used[pick]
        full[todo[good]] = full[pick[good]]
        todo, attempt = todo[~good], attempt + 1
    return full


def _sketches(bands: int, rows: int):
    weights = mix(np.arange(1, rows + 1).astype(_U)) | _U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in groups(whole, "text"):
                sets = shingle_sets(batch.column("text"))
                print_a = np.array([mix(s ^ _U(0xA5A5A5A5)).sum() for s in sets], _U).view(np.int64)
                print_b = np.array([np.bitwise_xor.reduce(mix(s + _U(0x1234567))) if len(s) else 0 for s in sets], _U).view(np.int64)
                keys = np.zeros((len(sets), bands), _U)
                for i, s in enumerate(sets):
                    if len(s):
                        keys[i] = (one_permutation_sketch(s, bands * rows).reshape(bands, rows) * weights).sum(1)
                keys = mix(keys + np.arange(bands).astype(_U) * _U(0x632BE59BD9B4E019)).view(np.int64)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), bands).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(print_a), pa.array(print_b), flat],
                    ["doc_id", "n_shingles", "print_a", "print_b", "bands"],
                )

    return run


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in groups(whole, "text", 1 << 20):
            sets = shingle_sets(batch.column("text"))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate([*sets, np.zeros(0, _U)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "shingles"])


def _smallest(docs: DataFrame) -> DataFrame:
    """One row per doc_id, with its smallest text; null counts as empty."""
    return docs.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def _one_each(sketch: DataFrame, docs: DataFrame, sketched) -> DataFrame:
    """The rows of sketch with a doc_id, such that all rows of one doc_id are of the same set: where texts
    with different sets share a doc_id, the sketch of the smallest text stands for all of them."""
    known = sketch.where("doc_id is not null")
    prints = F.struct("n_shingles", "print_a", "print_b")
    several = cut(known.groupBy("doc_id").agg(F.min(prints).alias("low"), F.max(prints).alias("high")).where("low <> high").select("doc_id"), "several")
    if several.isEmpty():
        return known
    again = sketched(_smallest(docs.join(several, "doc_id", "left_semi")))
    return cut(known.join(several, "doc_id", "left_anti").unionByName(again), "sketch")


def _sets(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Shingle sets of these documents. Texts are moved by doc_id at every size, once."""
    some = _smallest(docs.join(reps.hint("merge"), "doc_id", "left_semi"))
    return cut(some.mapInArrow(_full_sets, "doc_id long, shingles array<long>"), "sets")


def _sized(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def salted(rows: DataFrame, hot: DataFrame, key: str, by: str) -> DataFrame:
    """Adds salt, by which the rows of a hot key are dealt evenly; 0 for others. The hot keys, fewer than HOT, stand
    in the expression: all rows get a salt, and few are of a hot key, so they aren't joined for it."""
    few = {r[key]: r["salts"] for r in hot.select(key, "salts").collect()}
    salts = F.lit(1)
    if few:
        of = F.create_map(*[F.lit(x) for pair in few.items() for x in pair])
        salts = F.when(F.col(key).isin(list(few)), F.element_at(of, F.col(key))).otherwise(salts)
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), salts).cast("int"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Adds `linked`: whether the full sets of a and b overlap enough. a may be one star's centre in many pairs."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    hot = hot_keys(_sized(pairs, "a"), "a")
    joined = salted(pairs.join(right, "b"), hot, "a", "b").join(for_salts(left, hot, "a"), ["a", "salt"])
    return joined.select("a", "b", (100 * both >= percent * (F.size("sa") + F.size("sb") - both)).alias("linked"))


def _prefixes(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A document's rarest shingles, enough that any two documents to be linked share one of them; at: how many of its
    shingles are rarer."""
    each = sets.join(rest, F.col("doc_id") == F.col("rep")).select("rep", "n_shingles", "component", F.explode("shingles").alias("bucket"))
    sizes = cut(_sized(each, "bucket").where("n > 1"), "sizes")
    hot = hot_keys(sizes, "bucket")
    counted = salted(each, hot, "bucket", "rep").join(for_salts(sizes, hot, "bucket"), ["bucket", "salt"], "left")
    listed = counted.groupBy("rep", "n_shingles", "component").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("often"), "bucket"))).alias("s"))
    length = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100) + 1
    rarest = listed.select("rep", "n_shingles", "component", F.posexplode(F.slice("s", F.lit(1), length.cast("int"))).alias("at", "s"))
    return rarest.where("s.often > 1").select("s.bucket", "rep", "n_shingles", "component", "at")


def _reachable(rows: DataFrame, hot: DataFrame, percent: int) -> DataFrame:
    """Without the members whose bucket can't be the first that they share with one they are to be linked with.

    Two documents share nothing rarer than the rarest shingle they share, so there the overlap is at most
    n_shingles - at; a member for which this is too little even with the bucket's smallest set, or the smallest that fits, has its links elsewhere.
    """
    least = for_salts(rows.groupBy("bucket").agg(F.min("n_shingles").alias("least")), hot, "bucket")
    other = F.greatest("least", F.ceil(F.col("n_shingles") * percent / 100))
    enough = (100 + percent) * (F.col("n_shingles") - F.col("at")) >= percent * (F.col("n_shingles") + other)
    return rows.join(least, ["bucket", "salt"]).where(enough).drop("least", "at")


def _compare_members(percent: int):
    """The local components of one bucket's members (or of two blocks of them), as links to their root."""

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        ids, block, component = (cell.column(c).to_numpy() for c in ("rep", "block", "component"))
        lists = cell.column("shingles").chunk(0)
        size = pa.compute.list_value_length(lists).to_numpy().astype(np.int64)
        kinds, place = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        member = np.repeat(np.arange(len(ids)), size)
        by_kind = member[np.argsort(place, kind="stable")]
        at = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(kinds)))])
        may = component[:, None] != component[None, :]
        if cell.column("low")[0] != cell.column("high")[0]:
            may &= block[:, None] != block[None, :]
        linked = np.zeros((len(ids), len(ids)), bool)
        ends = np.cumsum(size)
        for i in np.flatnonzero(may.any(1)):
            own = place[ends[i] - size[i] : ends[i]]
            long = at[own + 1] - at[own]
            rows = np.repeat(at[own] - (np.cumsum(long) - long), long) + np.arange(long.sum())
            both = np.bincount(by_kind[rows], minlength=len(ids))
            linked[i] = may[i] & (100 * both >= percent * (size + size[i] - both))
        some = np.flatnonzero(linked.any(1))
        root = local_roots(linked[np.ix_(some, some)], ids[some])
        return pa.table([pa.array(ids[some]), pa.array(root)], names=["a", "b"])

    return run


def near_duplicates(documents: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = ROWS, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """Groups documents whose sets of 5-word shingles overlap by at least `percent` %.

    Returns per document doc_id, n_shingles, component_id (the smallest doc_id reachable by links)
    and kept (doc_id = component_id).

    Words and shingles are 64-bit hashes of their bytes: two of n distinct ones fall together with a chance of about n^2 / 2^65 (3 % at
    10^9). Equal sets fall together first, by a 128-bit print of the set, and only the smallest doc_id of
    each goes on. One-permutation sketches give banded buckets. A bucket proposes a star: its
    smallest member against the others. Every proposal is checked on the full sets. A bucket whose
    members are then in different components loses its centre, which has been compared with all
    of them, and proposes another star. What `star_rounds` stars leave mixed is finished exactly: those
    documents' rarest shingles, as many as two documents to be linked can't both avoid, are
    buckets in the same way, without members that have too many rarer ones for a link there, and what stars leave mixed there is compared pair by pair inside tasks, in
    blocks, which give back only each local group's root. No bucket is capped, so a pair that shares one is never lost; that a pair of
    similarity 0.85 shares none has a chance of (1 - 0.85^6)^32, under 3e-7.

    A null or blank text has the empty set and is linked with nothing, also not with another empty
    one. Rows that repeat a doc_id fall together: the smallest text counts (null as empty) in every
    step, one row comes out. A null
    doc_id gets a row of its own text with component_id null and kept true, linked with nothing.
    Columns other than doc_id and text aren't read. An empty table gives an empty result.

    Keys that hold more than one in HOT of the rows (a bucket, a shingle, a star's centre) are salted: what
    is known of the key is copied to each salt, and their members are dealt over the salts.
    """
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known = docs.where("doc_id is not null")
    sketched = lambda texts: texts.mapInArrow(_sketches(bands, rows), "doc_id long, n_shingles long, print_a long, print_b long, bands array<long>")
    sketch = cut(sketched(docs), "sketch")
    one = _one_each(sketch, known, sketched)
    by_doc = one.groupBy("doc_id").agg(F.min(F.struct("n_shingles", "print_a", "print_b")).alias("p")).select("doc_id", "p.*")
    classes = one.where("n_shingles > 0").groupBy("print_a", "print_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    classes = cut(classes, "classes")
    buckets = classes.select("rep", "n_shingles", F.explode("bands").alias("bucket"))
    found = _link_buckets(buckets, known, percent, star_rounds)
    member = by_doc.join(classes.select("print_a", "print_b", "n_shingles", "rep"), ["print_a", "print_b", "n_shingles"], "left")
    labelled = member.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    out = labelled.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    nameless = sketch.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(nameless).select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _link_buckets(buckets: DataFrame, docs: DataFrame, percent: int, star_rounds: int) -> DataFrame:
    """Components (node, component) of the representatives linked by what the buckets propose."""
    sizes = cut(_sized(buckets, "bucket").where("n > 1"), "sizes")
    hot = hot_keys(sizes, "bucket")
    shared = salted(buckets, hot, "bucket", "rep").join(for_salts(sizes.select("bucket"), hot, "bucket"), ["bucket", "salt"])
    alive = cut(shared.withColumn("component", F.col("rep")), "alive")
    drop(sizes)
    sets = _sets(alive.select(F.col("rep").alias("doc_id")).distinct(), docs)
    state = _State(sets, percent)
    alive = state.stars(alive, star_rounds, hot)
    if not alive.isEmpty():
        rest = alive.select("rep", "n_shingles", "component").distinct()
        prefixes = cut(_prefixes(rest, sets, percent), "prefixes")
        hot = hot_keys(_sized(prefixes, "bucket"), "bucket")
        near = cut(_reachable(salted(prefixes, hot, "bucket", "rep"), hot, percent), "near")
        alive = cut(state.mixed(near, hot), "alive")
        drop(near)
        drop(prefixes)
        state.finish(state.stars(alive, star_rounds, hot), hot)
    for old in (sets, *state.written):
        drop(old)
    return state.labels


class _State:
    """The links found so far, the pairs compared so far, and the components."""

    def __init__(self, sets: DataFrame, percent: int) -> None:
        self.sets, self.percent = sets, percent
        none = sets.sparkSession.createDataFrame([], "a long, b long")
        self.links, self.tried, self.labels = none, none, components(none)
        self.written: list[DataFrame] = []

    def compare(self, near: DataFrame) -> None:
        """Compares (rep, centre) pairs whose sizes allow a link, once each."""
        fits = 100 * F.least("n_shingles", "centre_n") >= self.percent * F.greatest("n_shingles", "centre_n")
        pairs = near.where(fits).select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
        pairs = cut(pairs.join(self.tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            return
        checked = cut(_verified(pairs, self.sets, self.percent), "checked")
        self.written += [pairs, checked]
        self.tried = self.tried.unionByName(checked.select("a", "b"))
        good = checked.where("linked").select("a", "b")
        if not good.isEmpty():
            self.links = self.links.unionByName(good)
            self.labels = components(self.links)

    def finish(self, alive: DataFrame, hot: DataFrame) -> None:
        """Compares all members of the buckets inside tasks, long buckets in pairs of blocks."""
        long = for_salts(_sized(alive, "bucket").where(F.col("n") > BLOCK), hot, "bucket")
        each = alive.join(long, ["bucket", "salt"], "left").withColumn("n_blocks", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int"))
        each = each.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int"))
        each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        each = each.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
        each = each.select("bucket", "low", "high", "block", "rep", "component").join(self.sets, F.col("rep") == F.col("doc_id"))
        found = cut(each.groupBy("bucket", "low", "high").applyInArrow(_compare_members(self.percent), "a long, b long"), "finished")
        self.written += [alive, found]
        if not found.isEmpty():
            self.links = self.links.unionByName(found)
            self.labels = components(self.links)

    def mixed(self, rows: DataFrame, hot: DataFrame) -> DataFrame:
        """Only buckets with members of different components."""
        several = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
        return rows.join(for_salts(several, hot, "bucket"), ["bucket", "salt"], "left_semi")

    def stars(self, alive: DataFrame, rounds: int, hot: DataFrame) -> DataFrame:
        """Proposes stars around one centre of every bucket, again and again; returns what is left mixed."""
        for turn in range(rounds):
            order = F.struct(F.lit(0) if turn == 0 else F.xxhash64("bucket", "rep", F.lit(turn)), "rep", "n_shingles", "component")
            centre = alive.groupBy("bucket").agg(F.min(order).alias("m"))
            centre = centre.select("bucket", F.col("m.rep").alias("centre"), F.col("m.n_shingles").alias("centre_n"), F.col("m.component").alias("centre_c"))
            near = cut(alive.join(for_salts(centre, hot, "bucket"), ["bucket", "salt"]).where("rep <> centre"), "stars")
            self.compare(near.where("component <> centre_c"))
            left = near.select("bucket", "salt", "rep", "n_shingles").join(self.labels, F.col("rep") == F.col("node"), "left")
            left = left.select("bucket", "salt", "rep", "n_shingles", F.coalesce("component", "rep").alias("component"))
            newer = cut(self.mixed(left, hot), "alive")
            drop(near)
            drop(alive)
            alive = newer
            if alive.isEmpty():
                break
        return alive
