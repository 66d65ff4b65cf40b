"""Full-text matches by positional postings: words, phrases, words near each other, prefixes, and what must not be there."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import scored


def _words(text: str) -> tuple[str, ...]:
    return tuple(w for w in re.split(r"[\W_]+", text.lower()) if w)


def _earlier(positions: Column, k: int) -> Column:
    return F.transform(positions, lambda x: x - F.lit(k))


class Unit:
    """Something to look for in a chunk's words."""

    def terms(self) -> set[str]:
        """The words whose postings are needed; one that ends in * stands for all words that begin so."""
        raise NotImplementedError

    def places(self, at: dict[str, Column]) -> Column:
        """Where it occurs, given each term's positions (empty arrays where there are none)."""
        raise NotImplementedError


@dataclass(frozen=True)
class Phrase(Unit):
    """Words that follow each other; a single word is a phrase too."""

    text: str

    def terms(self) -> set[str]:
        return set(_words(self.text))

    def places(self, at: dict[str, Column]) -> Column:
        starts = [_earlier(at[w], k) for k, w in enumerate(_words(self.text))]
        return functools.reduce(F.array_intersect, starts) if starts else F.array().cast("array<int>")


@dataclass(frozen=True)
class Prefix(Unit):
    """Any word that begins so."""

    text: str

    def terms(self) -> set[str]:
        return {f"{_words(self.text)[0]}*"} if _words(self.text) else set()

    def places(self, at: dict[str, Column]) -> Column:
        return at[f"{_words(self.text)[0]}*"] if _words(self.text) else F.array().cast("array<int>")


@dataclass(frozen=True)
class Near(Unit):
    """All of the words with at most `within` others between the first and the last of them, in any order."""

    text: str
    within: int = 10

    def terms(self) -> set[str]:
        return set(_words(self.text))

    def places(self, at: dict[str, Column]) -> Column:
        own = sorted(self.terms())
        if not own:
            return F.array().cast("array<int>")
        first = functools.reduce(F.array_union, [at[w] for w in own])
        # Between the first and the last there are their distance less one.
        reach = F.lit(self.within + 1)
        return F.filter(first, lambda p: functools.reduce(Column.__and__, [F.exists(at[w], lambda q: (q >= p) & (q <= p + reach)) for w in own]))


def _found(postings: DataFrame, units: Iterable[Unit]) -> tuple[DataFrame, dict[Unit, Column]]:
    """One row a chunk with any of the units' words, and how often each unit occurs in it: only those words' postings are read."""
    units = list(dict.fromkeys(units))
    terms = sorted(set().union(*(u.terms() for u in units)))
    names = {t: f"_p{k}" for k, t in enumerate(terms)}
    whole = [t for t in terms if not t.endswith("*")]
    fits = {t: F.startswith("term", F.lit(t[:-1])) if t.endswith("*") else F.col("term") == t for t in terms}
    read = functools.reduce(Column.__or__, [F.col("term").isin(whole)] * bool(whole) + [fits[t] for t in terms if t.endswith("*")], F.lit(False))
    held = postings.where(read).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("_rows"), *[F.flatten(F.collect_list(F.when(fits[t], F.col("positions")))).alias(names[t]) for t in terms])
    counts = {u: F.size(u.places({t: F.col(n) for t, n in names.items()})).cast("long") for u in units}
    return held, counts


def matched(postings: DataFrame, all_of: Iterable[Unit | Iterable[Unit]], none_of: Iterable[Unit] = ()) -> DataFrame:
    """Chunks that have every one of all_of and nothing of none_of: (chunk_id, tf0, tf1, ...).

    postings: term, chunk_id, positions. Each of all_of is a unit, or several of which one is enough; tf0 and so on count
    their occurrences. One aggregate by chunk over the postings of the words that are asked for; a chunk's positions stay in its row.
    Without anything to have, nothing matches.
    """
    wanted = [(u,) if isinstance(u, Unit) else tuple(u) for u in all_of]
    banned = list(none_of)
    if not wanted:
        return postings.select("chunk_id").limit(0)
    held, counts = _found(postings, [u for some in wanted for u in some] + banned)
    rows = held.select("chunk_id", *(sum((counts[u] for u in some[1:]), counts[some[0]]).alias(f"tf{k}") for k, some in enumerate(wanted)), sum((counts[u] for u in banned), F.lit(0)).alias("_banned"))
    return rows.where(" AND ".join([*(f"tf{k} > 0" for k in range(len(wanted))), "_banned = 0"])).drop("_banned")


def best_matches(postings: DataFrame, lengths: DataFrame, all_of: Iterable[Unit | Iterable[Unit]], k: int, none_of: Iterable[Unit] = ()) -> DataFrame:
    """The k best of matched by BM25 (chunk_id, bm25), each of all_of counting as one word does: tf its occurrences, df the chunks that have it."""
    wanted = [(u,) if isinstance(u, Unit) else tuple(u) for u in all_of]
    if not wanted:
        return lengths.select("chunk_id", F.lit(0.0).alias("bm25")).limit(0)
    held, counts = _found(postings, [u for some in wanted for u in some])
    each = held.select("chunk_id", *(sum((counts[u] for u in some[1:]), counts[some[0]]).alias(f"tf{i}") for i, some in enumerate(wanted)))
    df = each.agg(*[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(wanted))])
    totals = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).join(F.broadcast(df))
    hits = matched(postings, wanted, none_of).join(lengths, "chunk_id")
    return scored(hits, totals, len(wanted)).orderBy(F.desc("bm25"), "chunk_id").limit(k)
