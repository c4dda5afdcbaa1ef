"""Periodic runs of words: found by recompression, and collapsed to their first period.

The words of many documents form one sequence, with a separator of its own between documents. Block
and pair compression in turns shrink it to one symbol per document; what each level replaced is a
run-length grammar. Equal stretches are cut alike on every level up to a symbol at their ends, so the
grammar tells how far two places agree by climbing while they agree and descending at the first
difference. For every period ``q`` the places of a grid are compared with the places ``q`` further on:
a run that is long enough covers such a pair, and its exact ends follow from the two extensions.

Defined results: a null or empty text has no words and no runs; a very long text is one sequence of its
task, at some hundred bytes a word; equal runs of several grid places or of multiples of a period are one
run with the smallest period; repeated rows and rows without an id give one result each; an empty table
gives an empty one; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import byte_texts

# Fixed values of the contract: a run has so many words, and so many periods, at least.
LEAST_WORDS = 24
LEAST_PERIODS = 3

# Documents share a grammar up to so many words; a longer one has its own. Grid places are compared in batches.
GRAMMAR_WORDS = 200_000
BATCH = 1 << 21


def _mixed(symbols: np.ndarray, salt: int) -> np.ndarray:
    """One bit per symbol, the same wherever the symbol stands."""
    x = (symbols.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)) & np.uint64(1) == 1


@dataclass
class Grammar:
    """Levels of a sequence: ``first[h][p]`` is the place on level ``h`` where symbol ``p`` of level ``h+1`` begins.

    The first and the last symbol of the sequence are separators, and separators are below ``separators``,
    each standing once; they are never compressed.
    """

    separators: int
    levels: list[np.ndarray]
    parent: list[np.ndarray] = field(default_factory=list)
    first: list[np.ndarray] = field(default_factory=list)
    blocks: list[bool] = field(default_factory=list)

    @classmethod
    def of(cls, sequence: np.ndarray, separators: int) -> Grammar:
        found = cls(separators, [sequence.astype(np.int32)])
        free = int(sequence.max()) + 1
        # Between two separators remains one symbol at last.
        salt = 0
        while True:
            free = found._compress_blocks(free)
            top = found.levels[-1]
            plain = top >= separators
            if not (plain[1:] & plain[:-1]).any():
                return found
            salt += 1
            free = found._compress_pairs(free, salt)

    def _add(self, starts: np.ndarray, above: np.ndarray, block: bool) -> None:
        size = len(self.levels[-1])
        head = np.zeros(size, np.int32)
        head[starts] = 1
        self.parent.append(np.cumsum(head, dtype=np.int32) - 1)
        self.first.append(np.append(starts, size).astype(np.int32))
        self.blocks.append(block)
        self.levels.append(above.astype(np.int32))

    def _compress_blocks(self, free: int) -> int:
        """Replace each maximal block of one symbol by a symbol for (symbol, length)."""
        row = self.levels[-1]
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        if len(starts) == len(row):
            return free
        lengths = np.diff(np.append(starts, len(row)))
        above = row[starts].astype(np.int64)
        many = np.flatnonzero(lengths > 1)
        names, place = np.unique((above[many] << 32) | lengths[many], return_inverse=True)
        above[many] = free + place
        self._add(starts, above, True)
        return free + len(names)

    def _compress_pairs(self, free: int, salt: int) -> int:
        """Part the symbols in two by their bits, and replace each pair of a left and a right one by a symbol."""
        row = self.levels[-1]
        bit, plain = _mixed(row, salt * 0x5851F42D), row >= self.separators
        inner = plain[1:] & plain[:-1]
        one = inner & ~bit[:-1] & bit[1:]
        other = inner & bit[:-1] & ~bit[1:]
        pairs = np.flatnonzero(one if one.sum() >= other.sum() else other)
        if not len(pairs):
            return free
        keep = np.ones(len(row), bool)
        keep[pairs + 1] = False
        starts = np.flatnonzero(keep)
        above = row[starts].astype(np.int64)
        names, place = np.unique((row[pairs].astype(np.int64) << 32) | row[pairs + 1], return_inverse=True)
        above[np.searchsorted(starts, pairs)] = free + place
        self._add(starts, above, False)
        return free + len(names)

    def agree(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """How many symbols are equal from places ``a < b`` on, or back from them.

        The places of a query lie in one document, so the separators end every extension. All queries
        climb a level at a time: as long as the symbols agree, a place inside a symbol of the next level
        moves to that symbol's end. From the first symbols that differ each query descends again, past
        what their parts have in common.
        """
        way = -1 if back else 1
        x, y = a.astype(np.int64), b.astype(np.int64)
        met = np.full(len(x), len(self.blocks), np.int32)
        active = np.arange(len(x))
        for h, block in enumerate(self.blocks):
            if not len(active):
                break
            row, parent, first = self.levels[h], self.parent[h], self.first[h]
            u, v = x[active], y[active]
            same = row[u] == row[v]
            met[active[~same]] = h
            active, u, v = active[same], u[same], v[same]
            pu, pv = parent[u], parent[v]
            if back:
                left_u, left_v = u - first[pu] + 1, v - first[pv] + 1
                inside = (first[pu + 1] - 1 != u) | (first[pv + 1] - 1 != v)
            else:
                left_u, left_v = first[pu + 1] - u, first[pv + 1] - v
                inside = (first[pu] != u) | (first[pv] != v)
            step = np.where(inside, np.minimum(left_u, left_v) if block else 1, 0) * way
            u, v = u + step, v + step
            x[active], y[active] = u, v
            # A block that ends before the other one: what follows differs.
            ends = inside & (left_u != left_v) if block else np.zeros(len(u), bool)
            met[active[ends]] = h
            active = active[~ends]
            x[active], y[active] = parent[u[~ends]], parent[v[~ends]]
        for h in reversed(range(len(self.blocks))):
            chosen = np.flatnonzero(met > h)
            if not len(chosen):
                continue
            row, first = self.levels[h], self.first[h]
            u, v = x[chosen], y[chosen]
            low_u, high_u, low_v, high_v = first[u], first[u + 1], first[v], first[v + 1]
            u, v = (high_u - 1, high_v - 1) if back else (low_u, low_v)
            common = np.minimum(high_u - low_u, high_v - low_v) if self.blocks[h] else 1
            step = np.where(row[u] == row[v], common, 0) * way
            x[chosen], y[chosen] = u + step, v + step
        return (x - a) * way


def _grid(sizes: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods to compare, in batches: every run of a document covers one of its period's.

    A run of ``q`` has at least ``max(24, 3 q) - q`` places that equal the place ``q`` further on.
    """
    periods = np.where(sizes >= LEAST_WORDS, sizes // LEAST_PERIODS, 0)
    ends = np.cumsum(periods)
    total = int(ends[-1]) if len(ends) else 0
    for low in range(0, total, BATCH):
        number = np.arange(low, min(total, low + BATCH))
        doc = np.searchsorted(ends, number, side="right")
        q = number - (ends[doc] - periods[doc]) + 1
        step = np.maximum(LEAST_WORDS, LEAST_PERIODS * q) - q
        count = -(-(sizes[doc] - q) // step)
        reached = np.cumsum(count)
        start = 0
        while start < len(q):
            before = reached[start - 1] if start else 0
            stop = max(int(np.searchsorted(reached, before + BATCH, side="right")), start + 1)
            part = slice(start, stop)
            of = np.repeat(np.arange(start, stop), count[part])
            place = np.arange(len(of)) - np.repeat(reached[part] - count[part] - before, count[part])
            yield begins[doc[of]] + place * step[of], q[of]
            start = stop


def runs_of(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(document, start, length, period)`` of all runs, by document, start and period.

    A document is an array of word numbers from 0 on.
    """
    n = len(documents)
    sizes = np.array([len(d) for d in documents], np.int64)
    begins = np.cumsum(sizes + 1) - sizes  # the sequence starts with a separator, and one follows each document
    sequence = np.empty(int(sizes.sum()) + n + 1, np.int64)
    sequence[np.append(0, begins + sizes)] = np.arange(n + 1)
    for d, begin in zip(documents, begins):
        sequence[begin:begin + len(d)] = d + (n + 1)
    grammar = Grammar.of(sequence, n + 1)
    row = grammar.levels[0]
    found = []
    for place, q in _grid(sizes, begins):
        same = row[place] == row[place + q]
        place, q = place[same], q[same]
        after = grammar.agree(place, place + q)
        # Too short on both sides is common; only what may become a run is followed back.
        before = grammar.agree(place - 1, place + q - 1, back=True)
        length = before + after + q
        good = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
        found.append(np.stack([(place - before)[good], length[good], q[good]]))
    start, length, q = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort([q, length, start])
    start, length, q = start[order], length[order], q[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, q = start[new], length[new], q[new]
    order = np.lexsort([q, start])
    start, length, q = start[order], length[order], q[order]
    doc = np.searchsorted(begins, start, side="right") - 1
    return doc, start - begins[doc], length, q


def _numbered(words: list[list[bytes]]) -> list[np.ndarray]:
    number: dict[bytes, int] = {}
    return [np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int64, len(ws)) for ws in words]


def _collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, q: np.ndarray) -> bytes:
    """The words without those that a run contains after its first period."""
    if not len(start):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, start + q, 1)
    np.add.at(edges, start + length, -1)
    kept = np.cumsum(edges[:-1]) == 0
    return b" ".join([w for w, k in zip(words, kept.tolist()) if k])


def _groups(texts: list[bytes]) -> Iterator[list[list[bytes]]]:
    group, size = [], 0
    for text in texts:
        words = text.split()
        if group and size + len(words) > GRAMMAR_WORDS:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for words in _groups(byte_texts(batch["text"])):
            doc, start, length, q = runs_of(_numbered(words))
            bounds = np.searchsorted(doc, np.arange(len(words) + 1))
            kept = [_collapsed(w, start[i:j], length[i:j], q[i:j]) for w, i, j in zip(words, bounds, bounds[1:])]
            runs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, q)], fields=list(_RUN))
            yield pa.RecordBatch.from_arrays(
                [batch["id"].slice(at, len(words)), pa.array([len(w) for w in words], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs), pa.array(kept, pa.binary()).cast(pa.string())],
                ["id", "n_words", "runs", "collapsed"],
            )
            at += len(words)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, runs, collapsed)`` per document: runs by start and period, and the text without their repeats.

    Words are numbered from 0. A run is a maximal stretch of words with smallest period ``period``, of at
    least three periods and 24 words. No row leaves its task.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        _found, f"id {id_type}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    ).withColumnRenamed("id", id_col)


def strongest(runs_col: str = "runs"):
    """The run of greatest exact length over period (ties: smallest start, then period), null without runs."""
    better = lambda r, best: (
        (r["length"] * best["period"] > best["length"] * r["period"])
    )
    first = F.get(F.col(runs_col), F.lit(0))
    return F.aggregate(F.col(runs_col), first, lambda best, r: F.when(better(r, best), r).otherwise(best))


def plant_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The text as words with one blank between; in a tenth of the documents, by a checksum of the id, the words
    from some place on repeat with some period, as the contract of the query states. A row without an id keeps
    its words."""

    @F.arrow_udf("string")
    def planted(ids: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for h, text in zip(ids.to_pylist(), byte_texts(texts)):
            words = text.split()
            n = len(words)
            if h is not None and h % 10 == 0 and n:
                g = h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = words[:a] + [words[a + i % p] for i in range(n - a)]
            out.append(b" ".join(words))
        return pa.array(out, pa.binary()).cast(pa.string())

    checksum = F.crc32(F.col(id_col).cast("string"))
    return docs.select(F.col(id_col), planted(checksum, F.col(text_col)).alias(text_col))
