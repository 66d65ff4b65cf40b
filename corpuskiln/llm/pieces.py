"""SentencePiece BPE encoding and decoding; giant documents by a max-plus scan over chunks."""

from __future__ import annotations

import functools
import itertools
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, vocabulary_file

#: Characters of a chunk; matrices that one task multiplies.
CHUNK, FAN = 32768, 64
SPACE = "▁"
SCHEMA = "row long, doc_id long, part long, first_id long, ids array<int>, text string"


class Vocabulary:
    """A BPE model with byte fallback: pieces, scores, and which pieces may stand side by side.

    The merges give a text one encoding. A sequence of pieces is that encoding just if every two
    neighbours, merged by themselves, stay as they are; so encoding is a path through a lattice whose
    state is the last piece, in the max-plus semiring with the two weights 0 and minus infinity.
    """

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=vocabulary_file(model))
        sp = self.library
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.spelt = [b""] * sp.get_piece_size()
        for p, i in self.ids.items():
            self.spelt[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            self.spelt[i] = bytes([b])
        self.beside: dict[tuple[str, str], bool] = {}
        self.stretches: dict[str, list[int]] = {}

    def merged(self, text: str) -> list[str]:
        symbols = list(text)
        while len(symbols) > 1:
            best = max(range(len(symbols) - 1), key=lambda i: (self.scores.get(symbols[i] + symbols[i + 1], -np.inf), -i))
            if symbols[best] + symbols[best + 1] not in self.scores:
                break
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols

    def may_follow(self, left: str, right: str) -> bool:
        got = self.beside.get((left, right))
        if got is None:
            if len(self.beside) > 200_000:
                self.beside.clear()
            got = self.beside[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return got

    def stretch_ids(self, text: str) -> list[int]:
        """Ids of a stretch that no piece crosses the ends of: its one path through the lattice.

        Short stretches, mostly words, are kept; for them the merges propose the path, which is the lattice's if
        all its neighbours may stand side by side.
        """
        got = self.stretches.get(text)
        if got is None and len(text) <= 64:
            path = self.merged(text)
            if self.may_follow("", path[0]) and all(self.may_follow(a, b) for a, b in itertools.pairwise(path)):
                if len(self.stretches) > 200_000:
                    self.stretches.clear()
                got = self.stretches[text] = [i for piece in path for i in self.piece_ids(piece)]
        return _Chunk(self, text, 0).lattice_ids(0, 0, len(text)) if got is None else got

    def piece_ids(self, piece: str) -> list[int]:
        own = self.ids.get(piece)
        return [own] if own is not None else [self.bytes[b] for b in piece.encode()]

    def decode(self, ids: np.ndarray, first: bool) -> bytes:
        """The bytes of these ids; the space before a document's first piece isn't part of its text."""
        out = b"".join(map(self.spelt.__getitem__, ids.tolist()))
        return out[1:] if first and out[:1] == b" " else out


@functools.lru_cache(2)
def vocabulary(model: str) -> Vocabulary:
    """One for each worker process."""
    return Vocabulary(model)


#: How far before the cut the last piece ends, and its length: 0 at the text's start, and before the cut where
#: the next piece doesn't depend on it.
State = tuple[int, int]


class _Chunk:
    """One chunk with what stands before it: which last piece each position has, given an entry state.

    Where a space follows another character no piece of such a vocabulary goes across (`apart`), so every
    path has a piece end there and what follows doesn't depend on what came before: the matrix has rank
    one at these places. The transfer matrix therefore needs the lattice only from an entry to the first of them and from
    the last of them to the exit; the trace goes through all of it, stretch by stretch.
    """

    def __init__(self, words: Vocabulary, text: str, before: int) -> None:
        self.words, self.text, self.before = words, text, before
        inside = re.finditer(f"(?<=[^{SPACE}]){SPACE}", text[max(0, before - words.longest) :]) if words.apart else ()
        self.fixed = [m.start() + max(0, before - words.longest) for m in inside]
        self.ahead = [p for p in self.fixed if p > before]

    def run(self, start: int, length: int, stop: int, done: list[bytearray]) -> tuple[bytearray, int]:
        """Lengths of the last pieces at the positions start to stop, after a piece of `length` ends at start.

        It stops where it equals a done run to the same stop, and copies the rest of that one; done runs
        count positions back from stop. Returns the lengths and the number of that run, or -1.
        """
        words, text, most = self.words, self.text, self.words.longest
        last = bytearray(stop - start + 1)
        dead = 0
        for p in range(max(start, self.before) + 1, stop + 1):
            for n in range(min(most, p - start), 0, -1):  # one of them fits, mostly a long one
                q = p - n
                m = length if q == start else last[q - start]
                if q != start and not m:
                    continue
                piece = text[q:p]
                if (n == 1 or piece in words.ids) and words.may_follow(text[q - m : q] if m else "", piece):
                    last[p - start] = n
                    break
            dead = 0 if last[p - start] else dead + 1
            if dead >= most and p - start > most:
                break
            if p - start >= 2 * most:
                tail = stop - p
                for k, other in enumerate(done):
                    at = len(other) - 1 - tail
                    if at >= most and other[at - most + 1 : at + 1] == last[p - start - most + 1 : p - start + 1]:
                        last[p - start + 1 :] = other[at + 1 :]
                        return last, k
        return last, -1

    def _exits(self, start: int, last: bytearray, stop: int) -> list[State]:
        """States within reach of the chunk's end, of a run from start to it."""
        back = range(min(self.words.longest, stop - start))
        return [(d, last[stop - d - start] if d == 0 or stop - d not in self.fixed[-self.words.longest :] else 0) for d in back if last[stop - d - start]]

    def entries(self) -> list[State]:
        """Every piece that could be the last before the cut."""
        text, at, most = self.text, self.before, self.words.longest
        out: list[State] = []
        for d in range(min(most, at)):
            if d and at - d in self.fixed[: 2 * most]:
                out.append((d, 0))
            else:
                out += [(d, n) for n in range(1, min(most, at - d) + 1) if n == 1 or text[at - d - n : at - d] in self.words.ids]
        return out

    def transfer(self, first: bool) -> dict[State, list[State]]:
        """The transfer matrix: the exit states that each entry state reaches."""
        end, done, out = len(self.text), [], {}
        stop = self.ahead[0] if self.ahead else end
        if self.ahead:
            start = self.ahead[-1]
            tail, _ = self.run(start, 0, end, [])
            exits = self._exits(start, tail, end) + [(end - start, 0)] * (end - start < self.words.longest)
        for entry in [(0, 0)] if first else self.entries():
            start = self.before - entry[0]
            last, merged = self.run(start, entry[1], stop, done)
            if merged < 0:
                done.append(last)
            if self.ahead:
                found = exits if last[stop - start] else []
            else:
                found = self._exits(start, last, end) + [(end - start, 0 if start in self.fixed[: 2 * self.words.longest] else entry[1])] * (end - start < self.words.longest)
            if found:
                out[entry] = found
        return out

    def lattice_ids(self, start: int, length: int, stop: int) -> list[int]:
        last, _ = self.run(start, length, stop, [])
        p, pieces = stop, []
        while p > start:
            pieces.append(self.text[p - last[p - start] : p])
            p -= last[p - start]
        return [i for piece in reversed(pieces) for i in self.words.piece_ids(piece)]

    def trace(self, entry: State, leave: State) -> list[int]:
        """Ids of the pieces from the entry state's to the exit state's."""
        start, stop = self.before - entry[0], len(self.text) - leave[0]
        inner = [p for p in self.ahead if p <= stop]
        if not inner:
            return self.lattice_ids(start, entry[1], stop)
        ids = self.lattice_ids(start, entry[1], inner[0])
        for a, b in itertools.pairwise(inner):
            ids += self.words.stretch_ids(self.text[a:b])
        return ids + self.lattice_ids(inner[-1], 0, stop)


def _compose(a: dict, b: dict) -> dict:
    """The product of two transfer matrices."""
    out = {s: sorted({x for m in mids for x in b.get(m, ())}) for s, mids in a.items()}
    return {s: x for s, x in out.items() if x}


def crossings(matrices: list[dict], entry: State, leave: State) -> list[tuple[State, State]]:
    """Entry and exit state of every chunk: products over a binary tree, then the cuts from the top."""

    def tree(lo: int, hi: int):
        if hi - lo == 1:
            return (matrices[lo], None, None)
        left, right = tree(lo, (lo + hi) // 2), tree((lo + hi) // 2, hi)
        return (_compose(left[0], right[0]), left, right)

    out: list[tuple[State, State]] = []

    def walk(node, entry: State, leave: State) -> None:
        _, left, right = node
        if left is None:
            out.append((entry, leave))
            return
        (middle,) = [m for m in left[0][entry] if leave in right[0].get(m, ())]
        walk(left, entry, middle)
        walk(right, middle, leave)

    walk(tree(0, len(matrices)), entry, leave)
    return out


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """A batch a few rows at a time, so that few texts are Python objects at once."""
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def _whole(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for batch in batches:
            for rows in _slices(batch, 64):
                ids = words.library.encode(rows.column("text").to_pylist(), num_threads=1)
                ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                flat = np.fromiter((x for i in ids for x in i), np.int32, int(ends[-1]))
                zero = pa.array(np.zeros(rows.num_rows, np.int64))
                yield pa.RecordBatch.from_arrays([rows.column("row"), rows.column("doc_id"), zero, zero, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), rows.column("text")], ["row", "doc_id", "part", "first_id", "ids", "text"])

    return run


def _chunked(model: str, chunk: int):
    """Rows (row, part, parts, before, text, own): chunks with as much of the text before as states need;
    own: which of a chunk's SPACE are the document's and no spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = 2 * vocabulary(model).longest
        for batch in batches:
            for row, doc, said in zip(batch.column("row"), batch.column("doc_id"), batch.column("text"), strict=True):
                text = said.as_py()
                full = SPACE + text.replace(" ", SPACE)
                own = [i for i, c in enumerate(text, 1) if c == SPACE] if SPACE in text else []
                parts = -(-len(full) // chunk)
                for k in range(parts):
                    a = max(0, k * chunk - room)
                    here = [i - a for i in own[bisect_left(own, a) : bisect_left(own, (k + 1) * chunk)]]
                    names = ["row", "doc_id", "part", "parts", "before", "text", "own"]
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()], pa.int64()), pa.array([doc.as_py()], pa.int64()), pa.array([k], pa.int64()), pa.array([parts], pa.int64()), pa.array([k * chunk - a], pa.int64()), pa.array([full[a : (k + 1) * chunk]]), pa.array([here], pa.list_(pa.int64()))], names)

    return run


_MATRIX = "row long, part long, matrix array<int>"


def _flat(matrix: dict) -> list[int]:
    return [x for s, outs in matrix.items() for o in outs for x in (*s, *o)]


def _matrix(flat: list[int]) -> dict[State, list[State]]:
    matrix: dict[State, list[State]] = {}
    for a, b, c, d in zip(*[iter(flat)] * 4, strict=True):
        matrix.setdefault((a, b), []).append((c, d))
    return matrix


def _transfers(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for batch in batches:
            for row, part, before, text in zip(*(batch.column(c).to_pylist() for c in ("row", "part", "before")), batch.column("text"), strict=True):
                matrix = _Chunk(words, text.as_py(), before).transfer(part == 0)
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([part], pa.int64()), pa.array([_flat(matrix)], pa.list_(pa.int32()))], ["row", "part", "matrix"])

    return run


def _product(stretch: pa.Table) -> pa.Table:
    """One matrix of a stretch of neighbouring ones."""
    stretch = stretch.sort_by("part")
    whole = functools.reduce(_compose, map(_matrix, stretch.column("matrix").to_pylist()))
    return pa.table([stretch.column("row")[:1], stretch.column("stretch")[:1], pa.array([_flat(whole)], pa.list_(pa.int32()))], names=["row", "part", "matrix"])


_CUTS = "row long, part long, e_back int, e_len int, l_back int, l_len int"


def _resolve(stretch: pa.Table) -> pa.Table:
    """Entry and exit state of each of a stretch's matrices, from those of the stretch; l_back below 0: the text's end."""
    stretch = stretch.sort_by("part")
    matrices = [_matrix(flat) for flat in stretch.column("matrix").to_pylist()]
    e_back, e_len, l_back, l_len = (stretch.column(c)[0].as_py() for c in ("e_back", "e_len", "l_back", "l_len"))
    leave = (l_back, l_len)
    if l_back < 0:
        whole = functools.reduce(_compose, matrices)
        (leave,) = [s for s in whole[0, 0] if s[0] == 0]
    cuts = np.array([[*a, *b] for a, b in crossings(matrices, (e_back, e_len), leave)], np.int32)
    return pa.table([stretch.column("row"), stretch.column("part"), *(pa.array(c) for c in cuts.T)], names=[f.split()[0] for f in _CUTS.split(", ")])


def _all_cuts(matrices: DataFrame, most: int) -> DataFrame:
    """The states at every chunk's ends: matrices are multiplied FAN at a time, in a task for each stretch and
    level, and the cuts handed down the same way. most: of any text's chunks."""
    stretch = F.floor(F.col("part") / FAN).alias("stretch")
    levels = [matrices]
    while most > FAN:
        levels.append(cut(levels[-1].select("*", stretch).groupBy("row", "stretch").applyInArrow(_product, _MATRIX), "products"))
        most = -(-most // FAN)
    ends = [F.lit(x).alias(c) for c, x in (("e_back", 0), ("e_len", 0), ("l_back", -1), ("l_len", 0))]
    cuts = levels.pop().select("*", *ends).groupBy("row").applyInArrow(_resolve, _CUTS)
    while levels:
        cuts = levels.pop().select("*", stretch).join(cuts.withColumnRenamed("part", "stretch"), ["row", "stretch"]).groupBy("row", "stretch").applyInArrow(_resolve, _CUTS)
    return cuts


def _traced(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for batch in batches:
            for r in (x for rows in _slices(batch, 1) for x in rows.to_pylist()):
                chunk = _Chunk(words, r["text"], r["before"])
                ids = chunk.trace((r["e_back"], r["e_len"]), (r["l_back"], r["l_len"]))
                said = r["text"].replace(SPACE, " ")
                if r["own"]:
                    letters = list(said)
                    for i in r["own"]:
                        letters[i] = SPACE
                    said = "".join(letters)
                said = said[r["before"] - r["e_back"] : len(said) - r["l_back"]]
                values = [[r["row"]], [r["doc_id"]], [r["part"]], [len(ids)], [ids], [said[1:] if r["part"] == 0 else said]]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["row", "doc_id", "part", "n_ids", "ids", "text"])

    return run


def encode(documents: DataFrame, model: str, chunk: int = CHUNK, then: tuple[Callable, str] | None = None) -> DataFrame:
    """Ids of whole texts by a SentencePiece BPE model with byte fallback and identity normalising.

    Returns row (one number for each document row), doc_id, part, first_id (how many ids come
    before the part), ids and text (what of the document the part spells). A text of up to `chunk`
    characters is one part, encoded by the library. A longer one is cut into chunks in different
    tasks: each yields a transfer matrix between the pieces that may cross its two ends, the matrices
    are multiplied over a tree, FAN of them in a task, and every chunk is traced back by itself between the two states it
    then has, all of it through the lattice. The ids are those the library gives for the whole text. (The model at hand is a
    BPE model, whose encoding isn't the path of the largest sum of scores; the scan's weights are 0
    for neighbours the merges leave apart and minus infinity for others, see Vocabulary.)

    then (a function over Arrow batches of the result, and its schema) is applied in the same workers.

    A null or empty text is one part without ids. A null doc_id and repeated rows are encoded as they
    come. Other columns aren't read. An empty table gives an empty result.
    """
    docs = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    giant = F.length("text") > chunk
    # The two ways have numbers of their own, whatever order a second reading has.
    own = lambda rows, odd: rows.withColumn("row", 2 * F.col("row") + odd)
    after, schema = then or (lambda batches: batches, SCHEMA)
    whole = _whole(model)
    short = own(docs.where(~giant), 0).mapInArrow(lambda batches: after(whole(batches)), schema)
    chunks = cut(own(docs.where(giant), 1).mapInArrow(_chunked(model, chunk), "row long, doc_id long, part long, parts long, before long, text string, own array<long>"), "chunks")
    most = chunks.agg(F.max("parts")).first()[0]
    if most is None:
        return short
    matrices = cut(chunks.select("row", "part", "before", "text").repartition("row", "part").mapInArrow(_transfers(model), _MATRIX), "matrices")
    cuts = _all_cuts(matrices, most)
    traced = cut(chunks.join(cuts, ["row", "part"]).mapInArrow(_traced(model), "row long, doc_id long, part long, n_ids long, ids array<int>, text string"), "traced")
    drop(chunks)
    drop(matrices)
    earlier = Window.partitionBy("row").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = traced.select("row", "part", "n_ids").withColumn("first_id", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))).drop("n_ids")
    placed = traced.join(firsts, ["row", "part"]).select("row", "doc_id", "part", "first_id", "ids", "text")
    return short.unionByName(placed.mapInArrow(after, schema) if then else placed)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """row, doc_id, part and text: the ids of each part spelt out; parts in order are the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for batch in batches:
            out = [words.decode(ids.values.to_numpy(), part == 0).decode("utf-8", "replace") for ids, part in zip(batch.column("ids"), batch.column("part").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("part"), pa.array(out, pa.string())], ["row", "doc_id", "part", "text"])

    return encoded.mapInArrow(run, "row long, doc_id long, part long, text string")


MODULUS = 1_000_000_007


def check(model: str) -> tuple[Callable, str]:
    """What `checked` computes of each part, for encode(then=...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for batch in (rows for whole in batches for rows in _slices(whole, 256)):
            n, total, exact = [], [], []
            for ids, part, first, text in zip(batch.column("ids"), *(batch.column(c).to_pylist() for c in ("part", "first_id", "text")), strict=True):
                own = ids.values.to_numpy().astype(np.int64)
                said = words.decode(own, part == 0)
                n.append(len(own))
                total.append(int((own * ((first + 1 + np.arange(len(own))) % MODULUS) % MODULUS).sum() % MODULUS))
                exact.append(said == text.encode())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(total, pa.int64()), pa.array(exact, pa.bool_())], ["row", "doc_id", "n_ids", "ids_sum", "exact"])

    return run, "row long, doc_id long, n_ids long, ids_sum long, exact boolean"


def checked(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """Per document: doc_id, n_ids, ids_sum (sum of (place + 1) * id, modulo 1,000,000,007) and exact
    (the decoded text is the document's). encoded: what encode returns, with the model, or what it returns with then=check(model)."""
    parts = encoded.mapInArrow(*check(model)) if model else encoded
    merged = parts.groupBy("row", "doc_id").agg(F.sum("n_ids").alias("n_ids"), (F.sum("ids_sum") % MODULUS).alias("ids_sum"), F.min("exact").alias("exact"))
    return merged.select("doc_id", "n_ids", "ids_sum", "exact")
