"""Language-model scores: a Katz backoff model counted order by order and evaluated in partitioned tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .words import groups, mix, word_hashes

_U = np.uint64
ORDER, CELL_BYTES, PART_BYTES, LARGEST_GT = 3, 4 << 20, 8 << 20, 5
#: Contexts with more than one in MOST_HOT of all tokens, at least, are dealt over several parts: fewer than MOST_HOT.
MOST_HOT = 16384
#: Ids of what is no word of the corpus: the end, a document's start, and a word or context not learnt.
_END_HASH = mix(np.array([0x0123456789ABCDEF], _U))[0]
START, UNKNOWN = -2, -1


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block, byte planes apart, so that small numbers take little room."""
    head, body = [len(arrays)], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head += [ord(a.dtype.char), a.dtype.itemsize, len(a)]
        body.append(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, np.int64).tobytes() + b"".join(body))


def spread(block: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 1 + 3 * count)[1:].reshape(count, 3)
    out, at = [], 8 * (1 + 3 * count)
    for code, width, n in head.tolist():
        planes = np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(np.dtype(chr(code))))
        at += width * n
    return out


def _small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint32) if len(a) and a.min() >= 0 and a.max() < 2**32 else a.astype(np.int64)


def _sorted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers in order and where each was, equal ones in the order they had. Where both fit, value and place are
    sorted as one number, which takes a fraction of the time of an argsort."""
    bits = len(values).bit_length()
    low = int(values.min()) if len(values) else 0
    if len(values) and int(values.max()) - low < 1 << (63 - bits):
        both = np.sort((values.astype(np.int64) - low << bits) | np.arange(len(values)))
        return (both >> bits) + low, both & ((1 << bits) - 1)
    place = np.argsort(values, kind="stable")
    return values[place], place


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct integers in order, where each comes first, each value's rank and how often each comes."""
    ordered, place = _sorted(values)
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
    times = np.diff(np.append(first, len(ordered)))
    rank = np.empty(len(ordered), np.int64)
    rank[place] = np.repeat(np.arange(len(first)), times)
    return ordered[first], place[first], rank, times


def _distinct_hashes(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes in order and each one's rank: few distinct ones are found by hashing, and only they are sorted."""
    coded = pa.array(hashed).dictionary_encode()
    words = coded.dictionary.to_numpy()
    order = np.argsort(words)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    return words[order], rank[coded.indices.to_numpy()]


def _cells(parts: int, ask: bool):
    """Cuts a partition into cells of about CELL_BYTES of text.

    ask: per cell and part of the vocabulary, the distinct words' hashes and how often the cell's
    training documents hold them. Otherwise the cell's documents, tokens as places in that list. A cell's key is a
    hash of its place and of all its tokens, so a scan that deals or orders rows otherwise gives other keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []
        size = 0

        def cell() -> Iterator[pa.RecordBatch]:
            nonlocal number
            hashed = [word_hashes(b.column("text")) for b in held]
            counts = np.concatenate([c for _, c in hashed])
            ends = np.cumsum(counts + 1)
            tokens = np.empty(int(ends[-1]), _U)
            is_end = np.zeros(len(tokens), bool)
            is_end[ends - 1] = True
            tokens[is_end] = _END_HASH
            tokens[~is_end] = np.concatenate([w for w, _ in hashed])
            train = np.concatenate([b.column("train").to_numpy(zero_copy_only=False) for b in held]).astype(bool)
            ids = pa.concat_arrays([b.column("doc_id") for b in held])
            null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            places = np.arange(len(tokens)).astype(_U)
            rows = mix(ids.view(_U)) + counts.astype(_U) + train.astype(_U) * _U(7)
            said = np.concatenate([mix(tokens + mix(places)), mix(rows + mix(np.arange(len(rows)).astype(_U)))]).sum(keepdims=True)
            row = int(mix(said + _U(number))[0] >> _U(1))
            words, at = _distinct_hashes(tokens)
            part = (words % _U(parts)).astype(np.int64)
            order = np.lexsort((words, part))
            if ask:
                often = np.bincount(at, np.repeat(train, counts + 1), len(words)).astype(np.int64)[order]
                edge = np.searchsorted(part[order], np.arange(parts + 1))
                words = words[order]
                some = np.flatnonzero(np.diff(edge))
                blocks = [squeeze(words[edge[k] : edge[k + 1]], _small(often[edge[k] : edge[k + 1]])) for k in some]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array(blocks, pa.binary())], ["cell", "part", "block"])
            else:
                rank = np.empty(len(words), np.int64)
                rank[order] = np.arange(len(words))
                block = squeeze(_small(rank[at]), _small(counts), train, ids, null)
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([block], pa.binary())], ["cell", "block"])
            number += 1
            held.clear()

        for whole in batches:
            for batch in groups(whole, "text"):
                held.append(batch)
                size += batch.column("text").nbytes
                if size >= CELL_BYTES:
                    yield from cell()
                    size = 0
        if held:
            yield from cell()

    return run


def _count_words(parts: int):
    """Counts one part of the vocabulary and answers every cell that asks: ids (frequent words first) and
    counts. The part's totals stand in its first row."""

    def run(asked: pa.Table) -> pa.Table:
        part = asked.column("part")[0].as_py()
        blocks = [spread(b.as_py()) for b in asked.column("block")]
        words, at = np.unique(np.concatenate([b[0] for b in blocks]), return_inverse=True)
        often = np.bincount(at, np.concatenate([b[1] for b in blocks]).astype(np.float64), len(words)).astype(np.int64)
        order = np.lexsort((words, -often))
        ids = np.empty(len(words), np.int64)
        ids[order] = np.arange(len(words)) * parts + part
        ids[often == 0] = UNKNOWN
        ends = np.cumsum([len(b[0]) for b in blocks])
        out = [squeeze(_small(ids[p]), _small(often[p])) for p in np.split(at, ends[:-1])]
        sums = [pa.array([int(n), *[0] * (len(out) - 1)], pa.int64()) for n in (often.sum(), (often > 0).sum())]
        return pa.table([asked.column("cell"), asked.column("part"), pa.array(out, pa.binary()), *sums], names=["cell", "part", "block", "total", "kinds"])

    return run


class _Grams:
    """A cell's distinct n-grams of one order, in the order of their parts, and where the cell's tokens have them.

    place: per token, -1 where the order's context isn't known; ids, counts: of the n-grams, as far as
    they are known; own: their contexts' counts; weight: of backing off, where training doesn't hold the n-gram.
    A context that the documents, learnt or not, hold only once has its one follower once: such tokens are `lonely`, and
    nobody is asked about them. alone: tokens whose n-gram is such a context.
    """

    def __init__(self, place: np.ndarray, ids: np.ndarray | None, counts: np.ndarray | None, own: np.ndarray | None, lonely: np.ndarray) -> None:
        self.place, self.ids, self.counts, self.own, self.weight, self.lonely, self.alone = place, ids, counts, own, None, lonely, lonely


class _Cell:
    """One cell's tokens with what the parts have replied so far, order by order.

    An n-gram goes where its context goes; n-grams of a context seen more than `hot` times are
    dealt by their last token too, so that no part gathers a common context's followers.
    """

    def __init__(self, said: pa.Table, replies: pa.Table, order: int, parts: int, hot: int, starts: int) -> None:
        if said.num_rows != 1 or replies.num_rows == 0:
            raise ValueError("a cell's documents and its words' counts differ; documents must come in the same order when they are read again")
        self.cell, self.parts, self.hot = said.column("cell")[0].as_py(), parts, hot
        at, counts, self.train, self.doc_ids, self.null = spread(said.column("block")[0].as_py())
        blocks = {n: [spread(b.as_py()) for b in replies.filter(pa.compute.equal(replies.column("level"), n)).sort_by("part").column("block")] for n in range(1, order)}
        ids, often = (np.concatenate([b[k].astype(np.int64) for b in blocks[1]]) for k in (0, 1))
        counts = counts.astype(np.int64) + 1
        self.at, self.tokens, ends = at.astype(np.int64), counts, np.cumsum(counts)
        self.doc, self.c = np.repeat(np.arange(len(counts)), counts), often[self.at]
        self.words, self.first = ids, ends - counts
        self.by_word = _sorted(ids)[1]
        word = np.empty(len(ids), np.int64)
        word[self.by_word] = np.arange(len(ids))
        self.word_rank = word[self.at]
        #: A start is one more word, which only contexts have.
        self.levels = [_Grams(self.at, np.append(ids, START), np.append(often, starts), None, np.zeros(len(self.at), bool))]
        for n in range(2, order):
            self._add(blocks[n])

    def _add(self, blocks: list) -> None:
        grams = self.next_order(ask=False)
        total = np.concatenate([np.zeros(0, np.int64), *(b[0].astype(np.int64) for b in blocks)])
        if len(total) != len(grams.own):
            raise ValueError("a cell's n-grams and their counts differ; documents must come in the same order when they are read again")
        grams.counts, grams.weight = total, np.zeros(len(total))
        grams.weight[total == 0] = np.concatenate([np.zeros(0), *(b[1][b[2]] for b in blocks)])
        alone = np.concatenate([np.zeros(0, bool), *(np.unpackbits(b[3], count=len(b[0])).astype(bool) for b in blocks)])
        grams.ids = np.full(len(total), UNKNOWN)
        named = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(b[4].astype(np.int64)) for b in blocks)])
        if len(named):
            grams.ids[(total > 0) & ~alone] = named
        grams.alone = grams.lonely | np.append(alone, False)[grams.place]
        self.levels.append(grams)

    def next_order(self, ask: bool = True) -> _Grams:
        """The distinct n-grams one order above the last one, and, to ask, for each what its part has to know."""
        last, first = self.levels[-1], len(self.levels) == 1
        before = np.append(0, last.place[:-1])
        before[self.first] = len(last.ids) - 1 if first else -1
        lonely = np.append(False, last.alone[:-1])
        lonely[self.first] = False
        keep = np.flatnonzero((np.append(last.counts, 0)[before] > 0) & ~lonely)  # -1: the 0 at the end
        (_, by_id), by_word = _sorted(last.ids), self.by_word
        rank = np.empty(len(by_id), np.int64)
        rank[by_id] = np.arange(len(by_id))
        width = len(self.words)
        keys, index, place, times = _distinct(rank[before[keep]] * width + self.word_rank[keep])
        v = keys // width
        w = by_word[keys - v * width]
        v = by_id[v]
        ids, own = last.ids[v], last.counts[v]
        mixed = mix(ids.view(_U))
        common = (own > self.hot) | (ids == START)
        mixed[common] = mix(mixed[common] * _U(31) + mix(self.words[w[common]].view(_U)))
        part = mixed % _U(self.parts)
        order = np.argsort(part.astype(np.uint16) if self.parts < 1 << 16 else part, kind="stable")
        turned = np.empty(len(order), np.int64)
        turned[order] = np.arange(len(order))
        full = np.full(len(self.at), -1, np.int64)
        full[keep] = turned[place]
        grams = _Grams(full, None, None, own[order], lonely)
        if not ask:
            return grams
        grams.common = common[order]
        grams.part, grams.contexts, grams.last = part[order].astype(np.int64), ids[order], self.words[w[order]]
        grams.seen = np.bincount(place, self.train[self.doc[keep]], len(keys)).astype(np.int64)[order]
        grams.once = times[order] == 1
        lower = last.place[keep[index[order]]]
        grams.lower = last.counts[lower]
        grams.lower_own = None if first else last.own[lower]
        grams.edge = np.append(np.flatnonzero(np.append(True, grams.part[1:] != grams.part[:-1])[: len(order)]), len(order))
        return grams


def _ask(order: int, parts: int, hot: int, starts: int):
    """Per cell and part: each distinct n-gram once, with how often the cell's training documents hold it.

    A block: contexts (ascending, as steps), their numbers of n-grams and whether they are common, then per n-gram its last token (as
    steps within a context), the count that the n-gram without its first token has, how often it was seen and whether
    the cell holds it only once; how many lonely tokens the cell has (in its first block); and, above bigrams, per context the
    count of the context without its first token.
    """

    def run(said: pa.Table, replies: pa.Table) -> pa.Table:
        x = _Cell(said, replies, order, parts, hot, starts)
        g = x.next_order()
        blocks, lonely = [], int(g.lonely.sum())
        edges = list(zip(g.edge[:-1], g.edge[1:], strict=True)) or [(0, 0)]
        for a, b in edges:
            new = np.append(True, g.contexts[a + 1 : b] != g.contexts[a : b - 1])[: b - a]
            firsts = a + np.flatnonzero(new)
            last = g.last[a:b] + 1
            steps = np.where(new, last, last - np.append(0, last[:-1])[: b - a])
            extra = [] if g.lower_own is None else [_small(g.lower_own[firsts])]
            columns = [np.diff(g.contexts[firsts], prepend=0), _small(np.diff(np.append(firsts, b))), np.packbits(g.common[firsts]), _small(steps), _small(g.lower[a:b]), _small(g.seen[a:b]), np.packbits(g.once[a:b])]
            blocks.append(squeeze(*columns, np.array([0 if blocks else lonely]), *extra))
        own = [int(g.part[a]) if b else 0 for a, b in edges]
        return pa.table([pa.array([x.cell] * len(blocks), pa.int64()), pa.array(own, pa.int32()), pa.array(blocks, pa.binary())], names=["cell", "part", "block"])

    return run


_PART_SCHEMA = "part int, seen array<long>, cells array<long>, totals array<binary>, used array<long>, common array<boolean>, contexts binary, hot_first array<long>, hot_stats array<double>"
#: A context's statistics: how many followers it has with count 1 to LARGEST_GT, the sum of the larger counts; the lower
#: order's mass of its followers, in the same classes (bigrams: the sum of their count + 1, in the first); its own count.
_WIDTH = 2 * (LARGEST_GT + 1) + 1


def _count_grams(order: int, parts: int, more: bool):
    """Adds up one part's n-grams. Keeps each cell's n-grams' totals and ids in the cell's order and, of contexts whose
    weight some cell needs, the statistics. more: an order above will need to know the n-grams."""

    def run(table: pa.Table) -> pa.Table:
        own_part = table.column("part")[0].as_py()
        blocks = [spread(b.as_py()) for b in table.column("block")]
        for b in blocks:
            b[0] = np.cumsum(b[0].astype(np.int64))
        contexts, _, which, _ = _distinct(np.concatenate([b[0] for b in blocks]))
        common = np.zeros(len(contexts), bool)
        common[which] = np.concatenate([np.unpackbits(b[2], count=len(b[0])) for b in blocks]).astype(bool)
        many = np.concatenate([b[1].astype(np.int64) for b in blocks])
        v = np.repeat(which, many)
        steps = np.append(0, np.cumsum(np.concatenate([b[3].astype(np.int64) for b in blocks])))
        last, _, w, _ = _distinct(steps[1:] - np.repeat(steps[np.cumsum(many) - many], many))
        low = np.concatenate([b[4].astype(np.int64) for b in blocks])
        held = np.concatenate([b[5] for b in blocks]).astype(np.float64)
        lengths = [len(b[3]) for b in blocks]
        once = np.concatenate([np.unpackbits(b[6], count=len(b[3])) for b in blocks]).astype(bool)
        _, index, gram, askers = _distinct(v * len(last) + w)
        often = np.bincount(gram, held, len(index)).astype(np.int64)
        context, low = v[index], low[index]
        stats = np.zeros((len(contexts), _WIDTH))
        seen_ones = np.minimum(often, LARGEST_GT + 1)
        for r in range(1, LARGEST_GT + 2):
            amount = np.where(seen_ones == r, 1 if r <= LARGEST_GT else often, 0)
            stats[:, r - 1] = np.bincount(context, amount, len(contexts))
        if order == 2:
            stats[:, LARGEST_GT + 1] = np.bincount(context, np.where(often > 0, low + 1.0, 0), len(contexts))
        else:
            lower_own = np.zeros(len(contexts), np.int64)
            lower_own[which] = np.concatenate([b[8].astype(np.int64) for b in blocks])
            mass = np.where(often > 0, low / (lower_own[context] + 1.0), 0)
            kind = np.minimum(low, LARGEST_GT + 1)
            for r in range(1, LARGEST_GT + 2):
                stats[:, LARGEST_GT + r] = np.bincount(context, np.where(kind == r, mass, 0), len(contexts))
        # A context is seen as often as its followers are after it; a common one's parts add up.
        stats[:, -1] = np.bincount(context, often, len(contexts))
        seen = [int((often == r).sum()) for r in range(1, LARGEST_GT + 2)]
        seen[0] += sum(int(b[7][0]) for b in blocks)
        total, of = often[gram], v
        missed = total == 0
        used, use = np.unique(of[missed], return_inverse=True)
        ends = np.cumsum(lengths)[:-1]
        uses = np.split(use, np.cumsum([int(m.sum()) for m in np.split(missed, ends)])[:-1])
        alone = (total == 1) & (askers[gram] == 1) & once if more else np.zeros(len(gram), bool)
        named = (total > 0) & ~alone if more else np.zeros(len(gram), bool)
        per = zip(np.split(total, ends), uses, np.split(alone, ends), np.split(named, ends), np.split(gram, ends), strict=True)
        totals = [squeeze(_small(t), _small(u), np.packbits(a), np.diff(i[n] * parts + own_part, prepend=0)) for t, u, a, n, i in per]
        hot_at = np.flatnonzero(common)
        values = [[own_part], [seen], [table.column("cell").to_pylist()], [totals], [contexts[used]], [common[used]], [squeeze(*stats[used].T)], [contexts[hot_at].tolist()], [stats[hot_at].ravel().tolist()]]
        types = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64())]
        return pa.table([pa.array(x, t) for x, t in zip(values, types, strict=True)], names=[f.split()[0] for f in _PART_SCHEMA.split(", ")])

    return run


def discounts(seen: list[int]) -> np.ndarray:
    """Katz's Good-Turing discounts of counts 1 to k from how many n-grams have counts 1 to k + 1.

    Where the counts of counts give no discount between 0 and 1, (r - 1/2) / r takes its place.
    """
    k = len(seen) - 1
    plain = np.array([(r - 0.5) / r for r in range(1, k + 1)])
    if not all(seen) or (k + 1) * seen[k] >= seen[0]:
        return plain
    rest = (k + 1) * seen[k] / seen[0]
    katz = np.array([((r + 1) * seen[r] / (r * seen[r - 1]) - rest) / (1 - rest) for r in range(1, k + 1)])
    return np.where((katz > 0) & (katz < 1), katz, plain)


def backoff_weights(stats: np.ndarray, discount: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Exactly normalised: the mass the seen followers leave over the mass the lower order gives the rest.

    lower: what the classes of a context's lower mass are multiplied by.
    """
    kept = stats[:, :LARGEST_GT] @ (discount * np.arange(1, LARGEST_GT + 1)) + stats[:, LARGEST_GT]
    return (1 - kept / (stats[:, -1] + 1)) / (1 - stats[:, LARGEST_GT + 1 : -1] @ lower)


def _finish(level: int, discount: np.ndarray, lower: np.ndarray, hot_weights: dict[int, float]):
    """Per part and cell: its n-grams' totals and ids and, of those that training doesn't hold, the contexts' weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                stats = np.stack(spread(part["contexts"]), 1)
                common = np.array(part["common"], bool)
                weight = np.zeros(len(common))
                weight[~common] = np.log10(backoff_weights(stats[~common], discount, lower))
                weight[common] = [hot_weights[f] for f, hot in zip(part["used"], part["common"], strict=True) if hot]
                for cell, block in zip(part["cells"], part["totals"], strict=True):
                    total, use, alone, ids = spread(block)
                    which, place = np.unique(use, return_inverse=True)
                    out = squeeze(total, weight[which], _small(place), alone, ids)
                    yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.array([level], pa.int32()), pa.array([part["part"]], pa.int32()), pa.array([out], pa.binary())], ["cell", "level", "part", "block"])

    return run


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _evaluate(order: int, parts: int, hot: int, starts: int, discount: list[np.ndarray], total: int, room: float):
    """A cell's documents with their scores: every token by the highest order whose context is known, backing off
    through the lower ones."""

    def run(said: pa.Table, replies: pa.Table) -> pa.Table:
        x = _Cell(said, replies, order + 1, parts, hot, starts)
        alone = np.log10(x.c + 1.0) - np.log10(room)
        each = alone.copy()
        for grams, d in zip(x.levels[1:], discount, strict=True):
            kept = np.append(d, 1.0)[np.minimum(grams.counts, LARGEST_GT + 1) - 1]
            value = np.log10(np.maximum(grams.counts, 1) * kept) - np.log10(grams.own + 1.0)
            at = np.flatnonzero(grams.place >= 0)
            gram = grams.place[at]
            each[at] = np.where(grams.counts[gram] > 0, value[gram], grams.weight[gram] + each[at])
            each[grams.lonely] = np.log10(d[0] / 2)
        n = len(x.tokens)
        known = np.bincount(x.doc, x.c > 0, n).astype(np.int64)
        columns = [pa.array(x.doc_ids, mask=x.null), pa.array(~x.train), pa.array(x.tokens), pa.array(known), pa.array(np.full(n, total, np.int64)), pa.array(np.bincount(x.doc, alone, n)), pa.array(np.bincount(x.doc, each, n))]
        return pa.table(columns, names=[f.split()[0] for f in _RESULT.split(", ")])

    return run


def katz_scores(documents: DataFrame, held_out, order: int = ORDER, part_bytes: int = PART_BYTES) -> DataFrame:
    """Scores whole texts with a Katz backoff model of `order`, learnt from the documents outside `held_out`.

    Returns per row doc_id, held_out, n_tokens (words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, and
    one end), n_known (tokens that training holds), train_tokens (N), base_score (add-one unigrams:
    sum of log10((c + 1) / (N + V + 1))) and score, the model's log10 probability of the text.

    The model, for a token w after a context h (up to order - 1 tokens, with a start before a document's first), and h' = h without
    its first token: d(r) * r / (c(h) + 1) if training holds hw r > 0 times; a(h) * P(w | h') if it holds h but not hw;
    P(w | h') if it doesn't hold h. The lowest order is (c(w) + 1) / (N + V + 1).
    d are Good-Turing discounts of each order for r up to 5, 1 above. Each context keeps one count for what it
    hasn't shown, so a(h) is never 0; a(h) makes the probabilities of all V tokens and one unknown token sum to 1 exactly.

    Cells of documents ask the parts of the vocabulary for their distinct words' counts. Then order by order every
    distinct n-gram of a cell goes once, with the cell's count of it and what the orders below have replied, to the part that adds up
    its context's followers, or for a common context a share of them. The n-gram's total and id come back, with
    the context's weight where training doesn't hold the n-gram; at last the cell scores its own documents. What follows
    a context that occurs once in all documents needs no asking (see _Grams).
    Nothing of the vocabulary or of the n-grams is sent to the driver but sums and the weights of common contexts, fewer
    than MOST_HOT for each order.

    Words are 64-bit hashes of their bytes: two of n distinct ones fall together with a chance of about n^2 / 2^65 (3 % at 10^9).
    A null or empty text has the end alone. A null doc_id is kept; held_out decides about it. Repeated
    rows are scored each, and learnt each. Without training documents N = V = 0 and score equals
    base_score. Documents are read twice and must come in the same order again, as from files or a written table; the
    job fails if they don't. Columns other than doc_id and text aren't read. An empty table gives an empty result.
    """
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (~held_out).alias("train"))
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    starts = docs.where("train").count()
    parts = max(1, -(-size // part_bytes))
    asked = docs.mapInArrow(_cells(parts, True), "cell long, part int, block binary")
    answers = asked.groupBy("part").applyInArrow(_count_words(parts), "cell long, part int, block binary, total long, kinds long")
    answers = cut(answers, "counts")
    total, kinds = (int(n or 0) for n in answers.agg(F.sum("total"), F.sum("kinds")).first())
    room = float(total + kinds + 1)
    hot = max(1000, total // parts // 4, total // MOST_HOT)
    said = cut(docs.mapInArrow(_cells(parts, False), "cell long, block binary"), "cells")
    replies = answers.select("cell", F.lit(1).alias("level"), "part", "block")
    # A bigram's lower mass is one sum of counts; above, the lower order's classes are discounted as that order is.
    lower, discount = np.append(1 / room, np.zeros(LARGEST_GT)), []
    for n in range(2, order + 1):
        grams = said.groupBy("cell").cogroup(replies.groupBy("cell")).applyInArrow(_ask(n, parts, hot, starts), "cell long, part int, block binary")
        counted = cut(grams.groupBy("part").applyInArrow(_count_grams(n, parts, n < order), _PART_SCHEMA), "grams")
        seen = counted.agg(*[F.sum(F.col("seen")[k]) for k in range(LARGEST_GT + 1)]).first()
        discount.append(discounts([int(x or 0) for x in seen]))
        stats = counted.select(F.posexplode("hot_first").alias("i", "first"), "hot_stats").select("first", F.slice("hot_stats", F.col("i") * _WIDTH + 1, F.lit(_WIDTH)).alias("s"))
        added = stats.groupBy("first").agg(*[F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(_WIDTH)]).toPandas()
        weights = np.log10(backoff_weights(added.drop(columns="first").to_numpy(np.float64), discount[-1], lower)) if len(added) else []
        shares = counted.mapInArrow(_finish(n, discount[-1], lower, dict(zip(added["first"].tolist(), weights, strict=True))), "cell long, level int, part int, block binary")
        replies = replies.unionByName(shares)
        lower = np.append(discount[-1], 1.0)
    return said.groupBy("cell").cogroup(replies.groupBy("cell")).applyInArrow(_evaluate(order, parts, hot, starts, discount, total, room), _RESULT)
