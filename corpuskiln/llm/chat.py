"""Chat formatting by columnar byte assembly, with the spans that carry loss."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template, fixed: <|start|>role<|sep|>text<|end|>\n for every turn.
START, MIDDLE, END = "<|start|>", "<|sep|>", "<|end|>\n"
#: Control strings of this and other templates; each starts with < or [ and has neither inside.
CONTROL = r"(<|\[)(\\*)(\|[a-z_]+\|>|/?s>|/?SYS>|/?INST\])"
PIECE_TURNS, PIECE_BYTES, LONG = 512, 32 << 20, 4096
SCHEMA = "conv_id long, piece long, turns long, text binary, loss_starts array<int>, loss_lengths array<int>"


def escape(texts: pa.Array) -> pa.Array:
    r"""Puts one backslash more after the first character of what looks like a control string.

    A text may hold control strings that have backslashes there already; they get one more too, so
    taking one away from each gives the text back.
    """
    return pc.replace_substring_regex(texts, CONTROL, r"\1\\\2\3")


def unescape(text: str) -> str:
    return re.sub(CONTROL, lambda m: m[1] + m[2][1:] + m[3], text)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data if data is not None else b"", np.uint8), offsets


def _scatter(out: np.ndarray, source: np.ndarray, starts: np.ndarray, lengths: np.ndarray, to: np.ndarray) -> None:
    """out[to[i] : to[i] + lengths[i]] = source[starts[i] : ...]: long segments by slices, the rest by index."""
    for i in np.flatnonzero(lengths > LONG):
        out[to[i] : to[i] + lengths[i]] = source[starts[i] : starts[i] + lengths[i]]
    short = lengths <= LONG
    lengths, starts, to = lengths[short], starts[short], to[short]
    inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(to, lengths) + inside] = source[np.repeat(starts, lengths) + inside]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """All turns in one buffer: the buffer, where turns start (and end), and each text's start and length."""
    fixed = np.frombuffer((START + MIDDLE + END).encode(), np.uint8)
    fixed_at = np.cumsum([0, len(START), len(MIDDLE), len(END)])
    n = len(roles)
    (role_data, role_at), (text_data, text_at) = _bytes(escape(roles)), _bytes(escape(texts))
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = np.diff(fixed_at)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(lengths.ravel())
    to = (ends - lengths.ravel()).reshape(n, 5)
    buffer = pa.allocate_buffer(int(ends[-1]) if n else 0)
    out = np.frombuffer(buffer, np.uint8)
    for k, part in enumerate((0, 2, 4)):
        _scatter(out, fixed, np.full(n, fixed_at[k]), lengths[:, part], to[:, part])
    _scatter(out, role_data, role_at[:-1], lengths[:, 1], to[:, 1])
    _scatter(out, text_data, text_at[:-1], lengths[:, 3], to[:, 3])
    return buffer, np.append(to[:, 0], ends[-1] if n else 0), to[:, 3], lengths[:, 3]


def _parts(batch: pa.RecordBatch, turns: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of at most so many turns and bytes, or one turn."""
    size = np.cumsum(sum(np.diff(_bytes(batch.column(c))[1]) for c in ("role", "text")))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right"))
        end = min(max(end, at + 1), at + turns, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def _format(piece_turns: int, piece_bytes: int):
    """Formats a partition ordered by conversation and turn; a piece is a run of one's turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done, held = None, 0, []
        for batch in batches:
            for rows in _parts(batch, piece_turns, piece_bytes):
                conv = rows.column("conv_id").fill_null(0).to_numpy()
                null = rows.column("conv_id").is_null().to_numpy(zero_copy_only=False)
                first = np.flatnonzero(np.concatenate([[True], (conv[1:] != conv[:-1]) | (null[1:] != null[:-1])]))
                buffer, turn_at, text_at, text_len = assemble(rows.column("role"), rows.column("text"))
                loss = pc.equal(rows.column("role"), "assistant").to_numpy(zero_copy_only=False)
                ends = np.append(first[1:], rows.num_rows)
                pieces = []
                for a in first:
                    own = (bool(null[a]), int(conv[a]))
                    done = done + 1 if own == last else 0
                    last = own
                    pieces.append(done)
                text = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(turn_at[np.append(first, rows.num_rows)].astype(np.int64)), buffer])
                starts = (text_at - np.repeat(turn_at[first], ends - first))[loss]
                list_at = pa.array(np.append(np.concatenate([[0], np.cumsum(loss)])[first], loss.sum()).astype(np.int32))
                lists = [pa.ListArray.from_arrays(list_at, pa.array(v.astype(np.int32))) for v in (starts, text_len[loss])]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("conv_id").take(pa.array(first)), pa.array(pieces, pa.int64()), pa.array((ends - first).astype(np.int64)), text.cast(pa.binary()), *lists],
                    ["conv_id", "piece", "turns", "text", "loss_starts", "loss_lengths"],
                )

    return run


def format_chat(conversations: DataFrame, piece_turns: int = PIECE_TURNS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Formats conversations, one row a turn, into text with the spans of what carries loss.

    Returns per piece conv_id, piece (from 0; a conversation is as many pieces as its turns need, most
    have one), turns, text (UTF-8 bytes) and the starts and lengths in bytes of the assistant turns'
    texts. A conversation's pieces, in order, are its formatted text; they follow each other in one
    partition. A piece is at most `piece_turns` turns and `piece_bytes` bytes, or one turn, however long a conversation
    is; a task holds one piece beside its input batch. One conversation is one task's, as its digests are over its turns in
    their order.

    Turns are ordered by turn, then role, then text, nulls first, so repeated rows all stay. A null
    role or text is empty. Rows with a null conv_id are one conversation. Other columns aren't read.
    An empty table gives an empty result.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_format(piece_turns, piece_bytes), SCHEMA)


_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(END), re.S)


def read_back(text: bytes) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted piece."""
    return [(unescape(a), unescape(b)) for a, b in _TURN.findall(text.decode())]


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in DIGEST.split(", ")]
    rows: list[tuple] = []
    conv, state = None, None

    def written(kept: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*kept, strict=True), types, strict=True)], names)

    def row() -> tuple:
        return (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    for batch in batches:
        for own, piece, turns, text, starts, lengths in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "turns", "text", "loss_starts", "loss_lengths")), strict=True):
            if piece == 0:
                if state:
                    rows.append(row())
                conv, state = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, -1]
            if state is None or own != conv or piece != state[5] + 1:
                raise ValueError(f"piece {piece} of conversation {own} is out of order")
            said = read_back(text)
            if len(said) != turns:
                raise ValueError(f"conversation {own}: {len(said)} turns read back of {turns}")
            for role, words in said:
                state[1].update(f"{role}\n{words}\n".encode())
            for a, n in zip(starts, lengths, strict=True):
                words = unescape(text[a : a + n].decode())
                state[2] += len(words)
                state[3].update(words.encode())
            state[0], state[4], state[5] = state[0] + turns, state[4] + len(text.decode()), piece
        if rows:
            yield written(rows)
            rows = []
    if state:
        yield written([*rows, row()])


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted pieces say, read back from them in their order."""
    return formatted.mapInArrow(_digest, DIGEST)
