"""Spelling variants: words one edit apart, found by pivotal grams."""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, for_salts, hot_keys, salted

LEAST_LENGTH, LEAST_COUNT, RATIO, ONE_IN = 6, 5, 5, 199
#: How many distinct words a task counts before it passes them on.
HELD = 200_000
#: Letters are those of Latin-1, so that a word is its bytes there; only A-Z is lower-cased, all else parts words.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """All words of a text, in Latin-1."""
    return (text or "").encode("latin-1", "replace").translate(_LETTERS).split()


def _counted(one_in: int | None, least_length: int):
    """Words with their counts. With one_in, the words that a hash of document and word picks lose a letter first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def written() -> pa.RecordBatch:
            words, counts = [w.decode("latin-1") for w in held], list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                begun = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(words_of(text.as_py())).items():
                    if len(word) < least_length:
                        continue
                    if one_in:
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), begun)
                        if h % one_in == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_length:
                                continue
                    held[word] += n
                if len(held) > HELD:
                    yield written()
        if held:
            yield written()

    return run


def word_counts(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, one_in: int | None = None) -> DataFrame:
    """Words (word, n) of at least that many letters and occurrences in documents (doc_id, text).

    A word is a maximal run of `[A-Za-z\\u00C0-\\u00FF]` with A-Z lower-cased. With one_in, a word whose crc32 of
    `<doc_id>:<word>` that number divides has lost the letter at crc32 % length before it is counted; a
    null doc_id is the empty string there. Counts are added up in tasks first, then by word.
    """
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    each = docs.mapInArrow(_counted(one_in, least_length), "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _pivots(ranks: dict[str, int]):
    """Per word its gram prefix, and two disjoint grams of it as pivots, each with the sides of the word that it ends or begins; and a bit for
    each letter (some share one), of which one edit changes two at most."""

    def of(word: str) -> tuple[int, list[tuple[int, bool]]]:
        order = [ranks[word[i : i + 2]] for i in range(len(word) - 1)]
        last = sorted(order)[2]
        places = [i for i, r in enumerate(order) if r <= last]
        # The rarest two grams that share no letter: best[i] is the rarest one that ends before place i.
        best, pair, at = None, None, 0
        for i in places:
            while places[at] <= i - 2:
                best = min(best, (order[places[at]], places[at])) if best else (order[places[at]], places[at])
                at += 1
            if best and (pair is None or best[0] + order[i] < pair[0]):
                pair = (best[0] + order[i], best[1], i)
        return last, [(i, i in pair[1:]) for i in places]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                words = batch.column("word").slice(at, 4096).to_pylist()
                columns: list[list] = [[], [], [], [], []]
                for word in words:
                    last, places = of(word)
                    letters = functools.reduce(lambda bits, c: bits | 1 << ord(c) % 60, word, 0)
                    for i, pivot in places:
                        for side in (f"<{word[: i + 2]}", f">{word[i:]}"):
                            for column, value in zip(columns, (word, last, side, pivot, letters), strict=True):
                                column.append(value)
                kinds = (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["word", "last", "side", "pivot", "letters"])

    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """All pairs (a, b) of distinct words of at least 4 letters that one inserted, deleted or replaced letter makes equal, each pair once with a < b.

    Grams are pairs of letters, ordered by how many words have them, rarest first. A word's prefix is its first three grams in that
    order (and those equal to the third); its pivots are the two disjoint ones among them with the smallest sum of ranks, chosen by
    dynamic programming. One edit leaves one pivot of either word untouched, and the word whose prefix reaches less far has a pivot
    in the other's prefix. The edit lies before or after that gram, so that the gram has the same place from the end or from the
    start, and all from there on is equal: pivots and prefixes are joined by the gram with that whole side of the word. Length
    and letters are bounds before the words themselves are compared.

    words: a column of distinct words; a-z and U+00C0 to U+00FF, so there are at most 8,100 grams, whatever the number of words.
    """
    words = words.where(F.length("word") >= 4)
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("gram"))
    counted = sorted((r.n, r.gram) for r in grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect())
    ranks = {gram: k for k, (_, gram) in enumerate(counted)}
    index = cut(words.select("word").mapInArrow(_pivots(ranks), "word string, last int, side string, pivot boolean, letters long"), "index")
    hot = hot_keys(index.groupBy("side").agg(F.count(F.lit(1)).alias("n")), "side")
    left = salted(index.where("pivot"), hot, "side", "word").select("side", "salt", F.col("word").alias("a"), F.col("last").alias("last_a"), F.col("letters").alias("letters_a"))
    right = for_salts(index, hot, "side").select("side", "salt", F.col("word").alias("b"), F.col("last").alias("last_b"), F.col("letters").alias("letters_b"))
    bounds = (F.col("last_a") <= F.col("last_b")) & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.bit_count(F.col("letters_a").bitwiseXOR(F.col("letters_b"))) <= 2)
    near = left.join(right, ["side", "salt"]).where(bounds & (F.levenshtein("a", "b", 1) == 1))
    out = cut(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near")
    drop(index)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """For each word with a form the last one that forms lead to: (word, root). Every step doubles the forms followed."""
    roots = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        followed = cut(roots.join(on, "root", "left"), "roots")
        drop(roots)
        roots = followed.select("word", F.coalesce("further", "root").alias("root"))
        if followed.where("further is not null").isEmpty():
            return roots
        roots._kiln_path = followed._kiln_path


def spelling_variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Groups words (word, n) one edit apart under the form that is far more common.

    Returns per word: word, form, root, n, n_near, form_n. n_near is its number of near words; form is the one of largest n (ties:
    the smallest in code-point order) if that n is at least `ratio` times the word's, else null with form_n; root is the last word
    that forms lead to, the word itself without a form. Forms grow by `ratio` at each step, so chains are short and have no rings.

    counts: distinct words of near_pairs' letters; rows with a null word are left out, as are other columns; words of
    fewer than 4 letters have no near words. Without rows the result is empty.
    """
    counts = cut(counts.where("word is not null").select("word", F.col("n").cast("long").alias("n")), "counts")
    pairs = near_pairs(counts)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    named = both.join(counts.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = named.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("low"), "near")).alias("best"))
    found = counts.join(best, "word", "left")
    fits = -F.col("best.low") >= ratio * F.col("n")
    found = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.low")).alias("form_n")), "forms")
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
