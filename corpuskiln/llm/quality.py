"""Quality scores: a generalised additive model with pairwise interactions over text statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import buffer_of, groups, hashes, mix, spans

_U = np.uint64
SAMPLE, BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 20000, 32, 120, 60, 8, 0.15
FEATURES = [
    "bytes", "words", "word_bytes", "upper", "digits", "symbols", "exclaims", "stops", "commas", "high_bytes",
    "spaces", "pipes", "lines", "line_bytes", "distinct_words", "repeated_lines", "repeated_pairs",
    "repeated_runs", "commonest_word", "symbol_ends", "capital_starts", "one_byte_words", "plain_words", "upper_words", "long_words",
]


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _LOWER, _DIGIT = _mask(bytes(range(65, 91))), _mask(bytes(range(97, 123))), _mask(b"0123456789")
_SYMBOL, _HIGH, _SPACE = _mask(b"#$%&*@^~_+=<>\\/{}[]|"), _mask(bytes(range(128, 256))), _mask(b" \t\r\n\x0b\x0c")
_KINDS = [_UPPER, _DIGIT, _SYMBOL, _mask(b"!?"), _mask(b"."), _mask(b",;:"), _HIGH, _SPACE, _mask(b"|"), _mask(b"\n")]
_NEWLINE = _mask(b"\n")


def _repeats(keys: np.ndarray) -> float:
    return 1 - len(np.unique(keys)) / len(keys) if len(keys) else 0.0


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; an empty or null text has zeros."""
    data, offsets = buffer_of(texts)
    starts, ends, counts = spans(data, offsets)
    words, size = hashes(data, starts, ends), ends - starts
    line_starts, line_ends, line_counts = spans(data, offsets, _NEWLINE)
    line_keys = hashes(data, line_starts, line_ends, lower=False)

    def per_text(flags: np.ndarray, ends_at: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)])
        return np.diff(total[ends_at])

    at_words, at_lines = (np.concatenate([[0], np.cumsum(c)]) for c in (counts, line_counts))
    n_bytes, n_words = np.diff(offsets), np.maximum(counts, 1)
    share = [per_text(k[data], offsets) / np.maximum(n_bytes, 1) for k in _KINDS]
    first = data[starts] if len(starts) else np.zeros(0, np.uint8)
    last = data[ends - 1] if len(ends) else first
    second = data[np.minimum(starts + 1, ends - 1)] if len(starts) else first
    word_share = [per_text(f, at_words) / n_words for f in (_SYMBOL[last] | (last == 33), _UPPER[first], size == 1, (_LOWER[first] | _HIGH[first]) & (_LOWER[last] | _HIGH[last]), _UPPER[first] & _UPPER[second] & (size > 1), size > 14)]
    loops = []
    for i in range(len(texts)):
        w, lines = words[at_words[i] : at_words[i + 1]], line_keys[at_lines[i] : at_lines[i + 1]]
        if not len(w):
            loops.append((0, 0, 0, 0, 0))
            continue
        kinds, often = np.unique(w, return_counts=True)
        runs = mix(w[:-4] + w[1:-3] * _U(3) + w[2:-2] * _U(5) + w[3:-1] * _U(7) + w[4:] * _U(9)) if len(w) > 4 else w[:0]
        loops.append((len(kinds) / len(w), _repeats(lines), _repeats(w[:-1] * _U(3) + mix(w[1:])), _repeats(runs), often.max() / len(w)))
    loop = np.array(loops, float).reshape(len(texts), 5)
    columns = [np.log1p(n_bytes), np.log1p(counts), per_text(size, at_words) / n_words if len(size) else n_words * 0.0]
    columns += [*share[:9], np.log1p(line_counts), n_bytes / np.maximum(line_counts, 1), *loop.T, *word_share]
    return np.stack(columns, 1)


class Additive:
    """Cut points and lookup tables: logit = bias + one table per feature + one per chosen pair."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        """Boosts shallow trees on one feature at a time, in turn, then on the pairs that gain most."""
        n, d = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)] if n else [np.zeros(0)] * d
        self.rough = [c[:: max(1, len(c) // 7)][:7] for c in self.cuts]
        self.bias = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int]] = []
        self.grids: list[np.ndarray] = []
        if not n:
            return
        bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)]
        logit = np.full(n, self.bias)

        def push(at: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-logit))
            return np.bincount(at, y - p, cells), np.bincount(at, p * (1 - p), cells)

        for _ in range(ROUNDS):
            for j, at in enumerate(bins):
                step = RATE * _stumps(*push(at, len(self.tables[j])))
                self.tables[j] += step
                logit += step[at]
        wide = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.rough)]
        gains = {}
        for i in range(d):
            for j in range(i + 1, d):
                g, h = push(wide[i] * 8 + wide[j], 64)
                gains[i, j] = float((g * g / (h + 5)).sum())
        self.pairs = sorted(gains, key=lambda k: -gains[k])[:PAIRS]
        self.grids = [np.zeros(64) for _ in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for k, (i, j) in enumerate(self.pairs):
                at = wide[i] * 8 + wide[j]
                step = RATE * _quarters(*push(at, 64))
                self.grids[k] += step
                logit += step[at]

    def scores(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.bias)
        for j, t in enumerate(self.tables):
            logit += t[np.searchsorted(self.cuts[j], x[:, j], "right")]
        for (i, j), t in zip(self.pairs, self.grids, strict=True):
            logit += t[np.searchsorted(self.rough[i], x[:, i], "right") * 8 + np.searchsorted(self.rough[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))


def _gain(g, h):
    return g * g / (h + 1.0)


def _stumps(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Newton steps of a tree of at most three leaves over one feature's bins."""
    step, parts = np.zeros(len(g)), [(0, len(g))]
    while len(parts) < leaves:
        best = None
        for k, (a, b) in enumerate(parts):
            if b - a > 1:
                cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
                gain = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
                at = int(gain.argmax())
                if best is None or gain[at] > best[0]:
                    best = (gain[at], k, a + at + 1)
        if best is None or best[0] <= 0:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    for a, b in parts:
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return step


def _quarters(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Newton steps of the best tree that cuts an 8 x 8 grid once each way."""
    cg, ch = (np.pad(v.reshape(8, 8).cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h))
    cut = np.arange(1, 8)
    part = lambda c: (c[cut][:, cut], c[cut, 8][:, None] - c[cut][:, cut], c[8, cut][None, :] - c[cut][:, cut], c[8, 8] - c[cut, 8][:, None] - c[8, cut][None, :] + c[cut][:, cut])
    gs, hs = part(cg), part(ch)
    i, j = np.unravel_index(sum(_gain(a, b) for a, b in zip(gs, hs, strict=True)).argmax(), (7, 7))
    upper, left = (np.arange(8) <= i)[:, None], (np.arange(8) <= j)[None, :]
    value = [float(a[i, j] / (b[i, j] + 1)) for a, b in zip(gs, hs, strict=True)]
    return np.where(upper, np.where(left, value[0], value[1]), np.where(left, value[2], value[3])).ravel()


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in groups(whole, "text"):
            x = features(batch.column("text"))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("y"), flat], ["y", "x"])


def _score(model: Additive, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in groups(whole, "text"):
                out = pa.array(model.scores(features(batch.column("text"))))
                yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, name])

    return run


def fit(documents: DataFrame, labels: DataFrame, held_out, sample: int = SAMPLE) -> Additive:
    """The model, learnt from at most `sample` labelled rows outside `held_out`.

    They are those with the smallest hash of doc_id; only their FEATURES (25 numbers a row) come to
    the driver. Without labelled rows every score is 0.5.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out)
    known = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(known), "doc_id")
    got = rows.select("text", "y").mapInArrow(_with_features, "y int, x array<double>").orderBy("x", "y").limit(sample).toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if got.num_rows else np.zeros((0, len(FEATURES)))
    return Additive(x, got.column("y").to_numpy().astype(float))


def held_out_rows():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of `documents` and score (0 to 1, higher: good likelier) and predicted (int).

    The model is learnt from `labels` on rows whose crc32(doc_id as text) mod 5 is not 0 (see fit), and
    sees nothing of a document but its whole text. A null or empty text has zeros for features and
    is scored like any other. Repeated rows each get a score; repeated labels count once, bad if any
    says so. Columns of `documents` named score or predicted are replaced. Empty tables give empty
    results.
    """
    model = fit(documents, labels, held_out_rows(), sample)
    rest = documents.drop(*names)
    scored = rest.mapInArrow(_score(model, names[0]), rest.withColumn(names[0], F.lit(0.0)).schema)
    return scored.withColumn(names[1], (F.col(names[0]) >= threshold).cast("int"))
