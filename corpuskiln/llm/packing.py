"""Packing token sequences: harmonic classes filled with a fixed number of pieces."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import vocabulary_file

CAPACITY, END_ID, LEAST = 2048, 1, 128
SCHEMA = "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"


def cuts(tokens: int, capacity: int = CAPACITY, least: int = LEAST) -> list[int]:
    """Lengths of a document's pieces: heads of exactly capacity // k, then one tail shorter than `least`."""
    out = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest >= least:
        k = -(-capacity // rest)
        k += capacity // k > rest
        out.append(capacity // k)
        rest -= capacity // k
    return out + [rest] * (rest > 0)


class _Tokens:
    """Ids of whole texts. Plain texts go through the same vocabulary as ranks, which gives the same ids
    sooner; one that names the vocabulary's special token goes through `tokenizers` itself, as does one
    that `tiktoken` refuses (its matcher has no room for about a million white-space characters in a row)."""

    SPECIAL = "<|endoftext|>"

    def __init__(self, tokenizer: str, ranks: str | None) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary_file(tokenizer))
        self.fast = None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(vocabulary_file(ranks), "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and self.SPECIAL not in text:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:
                pass
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(2)
def _tokens(tokenizer: str, ranks: str | None) -> _Tokens:
    """One for each worker process."""
    return _Tokens(tokenizer, ranks)


def _pack(tokenizer: str, ranks: str | None, capacity: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(tokenizer, ranks)
        sequence = TaskContext.get().partitionId() << 40
        bins: dict[int, list] = {}
        rows: list[tuple] = []

        def close(pieces: list) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids), ids, total, sequence, offset))
                offset += len(ids)
            sequence += 1

        def written() -> pa.RecordBatch:
            doc, start, length, ids, total, seq, offset = zip(*rows, strict=True)
            ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
            longs = [pa.array(v, pa.int64()) for v in (doc, start, length, total, seq, offset)]
            rows.clear()
            return pa.RecordBatch.from_arrays([*longs[:3], lists, *longs[3:]], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        size = 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(tokens.ids(text.as_py() or ""), np.uint32(END_ID))
                start = 0
                for length in cuts(len(ids), capacity, least):
                    k = capacity // length
                    held = bins.setdefault(k, [])
                    held.append((doc, start, ids[start : start + length].copy(), len(ids)))
                    start += length
                    if len(held) == k:
                        close(bins.pop(k))
                size += len(ids)
                if size > 1 << 18 and rows:
                    yield written()
                    size = 0
        pieces, room = [], capacity
        for _, held in sorted(bins.items()):
            for doc, start, ids, total in held:
                while len(ids):
                    pieces.append((doc, start, ids[:room], total))
                    start, used = start + min(room, len(ids)), min(room, len(ids))
                    ids, room = ids[used:], room - used
                    if not room:
                        close(pieces)
                        pieces, room = [], capacity
        if pieces:
            close(pieces)
        if rows:
            yield written()

    return run


def pack(documents: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = CAPACITY, least: int = LEAST) -> DataFrame:
    """Packs every document's ids, ended by id 1, into sequences of at most `capacity` ids.

    Returns per piece doc_id, start (its document's ids before it), length, ids, doc_tokens,
    sequence_id and offset (its place in the sequence). A class k holds the lengths in
    (capacity / (k + 1), capacity / k]; a bin of it is closed with its k-th piece. Documents are cut
    so that all pieces but a tail shorter than `least` fill their class's share exactly, so bins lose
    a few ids at most. Every task packs its own rows, without a shuffle; at its end the pieces in
    unfilled bins, fewer than the classes' counts, are laid end to end and cut at the capacity, so a
    task leaves one sequence unfilled at most. sequence_id holds the task's number above 40 bits.

    tokenizer is a file for `tokenizers`; ranks, if given, the same vocabulary for `tiktoken`. A null or
    empty text is the end id alone. A null doc_id and repeated rows are packed as they come. Columns
    other than doc_id and text aren't read. An empty table gives an empty result.
    """
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(_pack(tokenizer, ranks, capacity, least), SCHEMA)


def with_digest(pieces: DataFrame) -> DataFrame:
    """ids_crc32 (of the ids as little-endian unsigned 32-bit integers) in place of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat, ends = lists.flatten().to_numpy().astype("<u4"), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            out = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()) if n == "ids_crc32" else batch.column(n) for n in names], names)

    return pieces.mapInArrow(run, SCHEMA.replace("ids array<int>", "ids_crc32 long"))
