"""Scores of a language model whose n-grams are levels of a trie, spread over tasks.

Documents are coded in chunks of words, with A to Z in lower case. Order by order, each chunk sends its different n-grams, with their
counts in training documents, to the task that holds their context; contexts that are frequent anywhere are
dealt over several tasks by the next word. The task builds its part of the trie level: contexts, pointers to
their words and the words themselves are monotone sequences in Elias-Fano form, with the counts beside them and,
in the last order, quantised smoothed probabilities, in a memory-mapped file. Words are numbered relative to their
context, and an n-gram is found by a successor search in the stretch of its context. Place and counts go back to the
chunk, which works out the probability, and the place of an n-gram is the context of the next order; the last order
sends probabilities.

A probability is ``(count + prior * lower) / (count of the context + prior)``; the lowest order is the count plus
one half. All values between orders are quantised to 1/1024 of a decimal logarithm, so sums are exact and the
same for every partitioning.

Defined results: a null or empty text is the end token alone; a very long text is one chunk of its task, at
some 150 bytes a word; repeated rows and rows without an id give one score each, and rows without an id are
training rows; without training rows every token has probability one; an empty table gives an empty one; other
columns, whatever their names, are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.eliasfano import EliasFano, mapped

# Fixed values of the contract: every fifth document, by a checksum of its id, is held out.
FOLDS = 5
HELD_OUT = 1

# Up to five words, as n-gram tries are commonly built; in running text few of the longer ones are unknown.
ORDER = 5
# Weight of the lower order in occurrences, from the second order on (the last one counts for all further ones).
PRIORS = (1000.0, 5.0)
STEPS = 1024

# Words of a chunk, and texts added to it at once; occurrences of a context that may share a task; words of a task's contexts on average.
CHUNK_WORDS = 1 << 20
BATCH_ROWS = 1_024
CONTEXT_WORDS = 1 << 18
TASK_WORDS = 1 << 21

# The end of a text, which also stands before its first word. No word is empty.
END = b""

STATE, ASKED = 0, -1
_TAIL = "kind int, part int, held array<boolean>, data array<binary>, n bigint"


def _packed(values: np.ndarray) -> bytes:
    """Numbers by their bytes' places, compressed; whole numbers in as few bytes as hold them all, which the first byte tells."""
    if values.dtype.kind != "f":
        least, most = (int(values.min()), int(values.max())) if len(values) else (0, 0)
        kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= least and most <= np.iinfo(k).max)
        values = values.astype(kind, copy=False)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return bytes([values.itemsize]) + zstandard.compress(planes.tobytes(), 1)


def _unpacked(data: bytes, kind=np.int64) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.decompress(memoryview(data)[1:]), np.uint8).reshape(width, -1)
    stored = np.dtype(kind) if np.dtype(kind).kind == "f" else np.dtype(f"i{width}")
    return np.ascontiguousarray(planes.T).reshape(-1).view(stored).astype(kind, copy=False)


def _codes(probability: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(probability) * STEPS), 0, 65_535).astype(np.uint16)


# The probability of every code.
_PROBABILITY = 10.0 ** (np.arange(65_536) / -STEPS)


def _smoothed(count, lower: np.ndarray, context, prior: float) -> np.ndarray:
    return _codes((count + prior * _PROBABILITY[lower]) / (context + prior))


@lru_cache
def _after_one(prior: float) -> np.ndarray:
    """The code in a context that occurs once, by count (none, or the one) and by lower code."""
    every = np.arange(len(_PROBABILITY))
    return np.array([_smoothed(count, every, 1, prior) for count in (0, 1)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _share(chunk: int, parts: int) -> int:
    return int(_mixed(np.array([chunk]))[0] % np.uint64(parts))


def _row(chunk, kind, part=None, ids=None, held=None, data=None, n=None) -> tuple:
    return chunk, ids, kind, part, held, data, n


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [pa.int64(), pa.list_(id_type), pa.int32(), pa.int32(), pa.list_(pa.bool_()), pa.list_(pa.binary()), pa.int64()]
    columns = list(zip(*rows)) or [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                      ["chunk", "ids", "kind", "part", "held", "data", "n"])


# Chunks of documents ---------------------------------------------------------------------------


def _chunk_rows(chunk: int, ids: list, held: list, sizes: np.ndarray, tokens: np.ndarray, words: list[bytes], parts: int) -> list[tuple]:
    """The chunk itself, and what it asks about its words, of which the first is the end. Words are numbered by falling count."""
    train = np.repeat(~np.array(held, bool), sizes)
    every, trained = np.bincount(tokens, minlength=len(words)), np.bincount(tokens[train], minlength=len(words))
    order = np.argsort(-every, kind="stable")
    number = np.empty(len(order), np.uint32)
    number[order] = np.arange(len(order))
    names = [words[i] for i in order.tolist()]
    part = np.fromiter((zlib.crc32(w) % parts for w in names), np.int32, len(names))
    rows = [_row(chunk, STATE, _share(chunk, parts), ids, held, n=int(train.sum()),
                 data=[_packed(sizes.astype(np.int32)), _packed(number[tokens]), _packed(part), _packed(number[:1])])]
    by_part = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[by_part], np.arange(parts + 1))
    for p in range(parts):
        own = by_part[cuts[p]:cuts[p + 1]]
        if len(own):
            counts = [_packed(c[order][own].astype(np.int64)) for c in (trained, every)]
            rows.append(_row(chunk, ASKED, p, data=[zstandard.compress(b"\n".join([names[i] for i in own.tolist()]), 1), *counts]))
    return rows


def _split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of words of every text with its end, and the words with an empty one as the end of each text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    pieces = split.flatten().cast(pa.large_string())
    # Blanks at both ends of a text leave empty pieces.
    bounds = np.asarray(split.offsets).astype(np.int64) - split.offsets[0].as_py()
    real = np.asarray(pc.not_equal(pc.binary_length(pieces), 0).cast(pa.uint8())).view(bool)
    ends = np.append(0, np.cumsum(real))[bounds[1:]]
    return np.diff(ends, prepend=0) + 1, pieces if real.all() else pieces.filter(pa.array(real))


def _numbered(pieces: list[pa.Array], sizes: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The words of a chunk by their numbers, with the end of each text, and the words; the end has number 0."""
    encoded = pa.chunked_array(pieces, pa.large_string()).dictionary_encode()
    indices = [np.asarray(c.indices) for c in encoded.chunks]
    numbers = np.concatenate([*indices, np.zeros(0, np.int32)]).astype(np.int64) + 1
    words = encoded.chunk(0).dictionary.cast(pa.large_binary()).to_pylist() if encoded.num_chunks else []
    return np.insert(numbers, np.cumsum(sizes - 1), 0), [END, *words]


def _chunks(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        ids, held, sizes, pieces, size = [], [], [], [], 0
        id_type = None

        def rows() -> pa.RecordBatch:
            tokens, words = _numbered(pieces, np.concatenate(sizes))
            return _batch(_chunk_rows(chunk, ids, held, np.concatenate(sizes), tokens, words, parts), id_type)

        for whole in batches:
            id_type = whole["id"].type
            for first in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(first, BATCH_ROWS)
                found, words = _split(batch["text"].cast(pa.string()))
                ids += batch["id"].to_pylist()
                held += batch["held_out"].to_pylist()
                sizes.append(found)
                pieces.append(words)
                size += int(found.sum())
                if size >= CHUNK_WORDS:
                    yield rows()
                    chunk, ids, held, sizes, pieces, size = chunk + 1, [], [], [], [], 0
        if ids:
            yield rows()

    return run


def _word_level(parts: int):
    """Numbers and counts of the words of a part; ``n`` of the first answer tells how many are training words.

    Chunks pass through, so that they are written with the answers.
    """

    def run(table: pa.Table) -> pa.Table:
        passed, asked = _asked(table)
        if not asked:
            return passed
        names = [pc.split_pattern(pa.array([zstandard.decompress(r["data"][0])], pa.large_binary()), b"\n").flatten() for r in asked]
        encoded = pa.chunked_array(names).dictionary_encode()
        places = [np.asarray(c.indices) for c in encoded.chunks]
        different = len(encoded.chunk(0).dictionary)
        trained, every = ([_unpacked(r["data"][k]) for r in asked] for k in (1, 2))
        place = np.concatenate(places)
        train = np.bincount(place, np.concatenate(trained), different).astype(np.int64)
        both = np.bincount(place, np.concatenate(every), different).astype(np.int64)
        ranked = np.empty(different, np.int64)
        ranked[np.argsort(-both, kind="stable")] = np.arange(different)
        rows = []
        for k, (r, p) in enumerate(zip(asked, places)):
            data = [_packed(ranked[p]), _packed(train[p]), _packed(_others(train, both - train)[p])]
            rows.append(_row(r["chunk"], 1, r["part"], data=data, n=0 if k else int((train > 0).sum())))
        return _with(passed, rows, table)

    return run


def _others(count: np.ndarray, other: np.ndarray) -> np.ndarray:
    """What a chunk has to know of the other occurrences: one, if they make two in all, and their number in frequent contexts."""
    return np.where(count + other >= CONTEXT_WORDS, other, (count == 1) & (other > 0))


def _asked(table: pa.Table) -> tuple[pa.Table, list[dict]]:
    """The rows that pass through a task, and its questions by chunk."""
    asked = table.filter(pc.equal(table["kind"], ASKED)).select(["chunk", "part", "data"]).to_pylist()
    names = ["chunk", "ids", "kind", "part", "held", "data", "n"]
    return table.filter(pc.equal(table["kind"], STATE)).select(names), sorted(asked, key=lambda r: r["chunk"])


def _with(passed: pa.Table, rows: list[tuple], table: pa.Table) -> pa.Table:
    answers = pa.Table.from_batches([_batch(rows, table.schema.field("ids").type.value_type)])
    return pa.concat_tables([passed.cast(answers.schema), answers])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training tokens of the chunks, and different training words of the parts."""
    for batch in batches:
        total, distinct = (pc.sum(pc.if_else(pc.equal(batch["kind"], kind), batch["n"], 0)).as_py() or 0 for kind in (STATE, 1))
        yield pa.RecordBatch.from_pydict({"total": [total], "different": [distinct]})


class _Chunk:
    """A chunk with what it knows of its tokens: per token the n-gram that ends there, its counts and its code."""

    def __init__(self, rows: list[dict], parts: int, total: int, distinct: int):
        self.answers: dict[int, list[dict]] = {}
        for r in sorted(rows, key=lambda r: (r["kind"], r["part"] or 0)):
            if r["kind"] == STATE:
                state = r
            else:
                self.answers.setdefault(r["kind"], []).append(r)
        self.chunk, self.ids, self.held = state["chunk"], state["ids"], state["held"]
        self.sizes = _unpacked(state["data"][0])
        self.tokens = _unpacked(state["data"][1], np.int32)
        part = _unpacked(state["data"][2])
        end = int(_unpacked(state["data"][3])[0])
        self.first = np.cumsum(self.sizes) - self.sizes
        self.train = np.repeat(~np.array(self.held, bool), self.sizes)
        rank, known, other = np.empty((3, len(part)), np.int64)
        by_part = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
        for into, k in ((rank, 0), (known, 1), (other, 2)):
            into[by_part] = np.concatenate([_unpacked(r["data"][k]) for r in self.answers[1]])
        self.word, every = rank * parts + part, known + other
        self.word_rank = _ranks(self.word)
        single = (known + 0.5) / (total + 0.5 * (distinct + 1))
        self.known, self.single, self.code = known, single, _codes(single)[self.tokens]
        # The n-grams below the order are numbered in the chunk; of each, its counts, its place in the trie and the rank of that.
        self.count, self.every, self.nodes, self.ranks = known, every, self.word, self.word_rank
        # Of each token the number, and the kind: in no training text, once in all, or more often.
        kinds = _kinds(known, every)
        self.gram, self.kind = self.tokens, kinds[self.tokens]
        self.start = (end, kinds[end])

    def ask(self, order: int, priors: tuple, tasks: int, answered: bool = False):
        """What is unknown of the n-grams of this order: one row each, by task, context and word.

        A context without training words adds nothing. An n-gram is unknown only if its context and its shorter form both
        occur twice or more: what occurs once does so here, and of what no training text has nothing longer is there.
        Returns the asking tokens, the row of each, the rows' tasks and columns, of a question that is ``answered`` the last two.
        """
        prior = _prior(priors, order)
        gram, before = (_shifted(values, self.first, at_start) for values, at_start in
                        zip((self.gram, self.kind), self.start if order == 2 else (-1, 0)))
        asking = (before == _MORE) & (self.kind == _MORE)
        asked = np.flatnonzero(asking)
        shorter = self.code[asked]
        rare = np.flatnonzero(before == _ONCE)
        seldom = self.kind[rare] != _NONE
        none = np.flatnonzero((before == _MORE) & (self.kind == _NONE))
        once = np.flatnonzero((before == _MORE) & (self.kind == _ONCE))
        self.code[rare] = _after_one(prior)[seldom.view(np.uint8), self.code[rare]]
        for at, count in ((none, 0), (once, 1)):
            self.code[at] = _smoothed(count, self.code[at], self.count[gram[at]], prior)
        self.gram = np.full(len(gram), -1, np.int32)
        self.kind = np.zeros(len(gram), np.uint8)
        self.kind[rare] = seldom.view(np.uint8) * _ONCE
        self.kind[once] = _ONCE
        # By context and word, then by task: the second sort is stable, and quick on short numbers.
        contexts = gram[asked]
        key = self.ranks[contexts] * len(self.word) + self.word_rank[self.tokens[asked]]
        sort, key = _sorted(key, len(self.ranks) * len(self.word))
        starts = _starts(key)
        times = np.diff(np.append(starts, len(sort)))
        first = sort[starts]
        of = contexts[first]
        word = self.word[self.tokens[asked[first]]]
        task = self._tasks(of, word, tasks)
        by_task = np.argsort(task.astype(np.uint16) if tasks < 1 << 16 else task, kind="stable")
        place = np.empty(len(by_task), np.int32)
        place[by_task] = np.arange(len(by_task), dtype=np.int32)
        row = np.empty(len(sort), np.int32)
        row[sort] = np.repeat(place, times)
        columns = [shorter[first], self.count[of]]
        if not answered:
            trained = np.add.reduceat(self.train[asked[sort]].astype(np.int64), starts) if len(starts) else starts
            columns = [self.nodes[of], word, trained, times - trained, *columns]
        return asked, row, task[by_task], [c[by_task] for c in columns]

    def _tasks(self, context: np.ndarray, word: np.ndarray, tasks: int) -> np.ndarray:
        """The tasks of rows by context: one for a context, or one for each share of the words of a frequent one."""
        starts = _starts(context)
        runs = np.diff(np.append(starts, len(context)))
        each = context[starts]
        node = _mixed(self.nodes[each])
        task = np.repeat((_mixed(node) % np.uint64(tasks)).astype(np.int64), runs)
        shares = self.every[each] // CONTEXT_WORDS + 1
        many = np.flatnonzero(np.repeat(shares > 1, runs))
        share = _mixed(word[many]) % np.repeat(shares, runs)[many].astype(np.uint64)
        task[many] = (_mixed(np.repeat(node, runs)[many] + share) % np.uint64(tasks)).astype(np.int64)
        return task

    def advance(self, order: int, priors: tuple, tasks: int):
        """Take in the answers to the orders below, then ask for this one."""
        for below in range(2, order):
            asked, place, _, (shorter, context) = self.ask(below, priors, tasks, answered=True)
            if not len(asked):
                continue  # then no token has a count of two, and none is asked about in a longer order
            answers = self.answers[below]
            count, other, nodes = ([_unpacked(r["data"][k]) for r in answers] for k in range(3))
            nodes = [np.cumsum(n) * tasks + r["part"] for n, r in zip(nodes, answers)]
            self.count = np.concatenate(count)
            self.every = self.count + np.concatenate(other)
            code = _smoothed(self.count, shorter, context, _prior(priors, below))
            kinds = _kinds(self.count, self.every)
            self.nodes = np.full(len(kinds), -1, np.int64)
            self.nodes[kinds == _MORE] = np.concatenate(nodes)
            self.ranks = _ranks(self.nodes)
            self.code[asked], self.gram[asked], self.kind[asked] = code[place], place, kinds[place]
        return self.ask(order, priors, tasks)


_NONE, _ONCE, _MORE = range(3)


def _kinds(count: np.ndarray, every: np.ndarray) -> np.ndarray:
    """In no training text, once in all, or more often."""
    return np.where(count > 0, np.where(every > 1, _MORE, _ONCE), _NONE).astype(np.uint8)


def _shifted(values: np.ndarray, first: np.ndarray, at_start) -> np.ndarray:
    """The value of the token before each, ``at_start`` for the first ones of texts."""
    shifted = np.empty_like(values)
    shifted[1:] = values[:-1]
    shifted[first] = at_start
    return shifted


def _prior(priors: tuple, order: int) -> float:
    return priors[min(order - 2, len(priors) - 1)]


def _ranks(numbers: np.ndarray) -> np.ndarray:
    """Place of each number in their order, -1 for -1."""
    rank = np.full(len(numbers), -1, np.int64)
    used = np.flatnonzero(numbers >= 0)
    rank[used[_sorted(numbers[used], int(numbers.max(initial=0)) + 1)[0]]] = np.arange(len(used))
    return rank


def _unique(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers, none below 0, in order, and the place of each number among them."""
    sort, ordered = _sorted(numbers, int(numbers.max(initial=0)) + 1)
    starts = _starts(ordered)
    place = np.empty(len(sort), np.int64)
    place[sort] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(sort))))
    return ordered[starts], place


def _sorted(key: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys below ``limit``, and the keys in it; with their places in one number each where 63 bits hold both."""
    bits = len(key).bit_length()
    if limit.bit_length() + bits > 63:
        sort = np.argsort(key)
        return sort, key[sort]
    both = np.sort(key << bits | np.arange(len(key)))
    return both & (1 << bits) - 1, both >> bits


def _starts(row: np.ndarray) -> np.ndarray:
    """Places where a sorted row takes a new value."""
    return np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)


def _question(columns: list[np.ndarray], last: bool) -> list[bytes]:
    """Contexts once, with their rows; words by their distance from the one before.

    Only the last order answers with probabilities; it is told the lower ones and the counts of the contexts, and no other counts.
    """
    context, word, trained, held, code, count = columns
    first = _starts(context)
    steps = np.diff(word, prepend=0)
    steps[first] = word[first]
    rows = np.diff(np.append(first, len(context)))
    told = [np.diff(context[first], prepend=0), rows, steps, trained, held * (not last)] + last * [code, count[first]]
    return [_packed(c) for c in told]


def _read_question(data: list[bytes]) -> list[np.ndarray]:
    """Contexts and their numbers of rows; for each row its word, training and other count, and what the last order is told."""
    context, rows, steps, trained, held, *told = (_unpacked(d) for d in data)
    first = np.cumsum(rows) - rows
    sums = np.cumsum(steps)
    word = sums - np.repeat(sums[first] - steps[first], rows)
    code, count = (told[0], np.repeat(told[1], rows)) if told else np.zeros((2, 0), np.int64)
    return [np.cumsum(context), rows, word, trained, held, code, count]


def _asking(order: int, orders: int, priors: tuple, parts: int):
    """The questions of a chunk about one order; with the last order, also what the answers are added to.

    That row goes with the questions and comes back with the answers: sums per document, and the documents of each question.
    """

    def run(table: pa.Table) -> pa.Table:
        total, distinct = next(t for t in table["totals"].to_pylist() if t is not None)
        # Held-out documents are as long as others, on average; contexts of a part are bounded by their words.
        tasks = max(parts, -(-2 * total // TASK_WORDS))
        chunk = _Chunk(table.drop_columns("totals").to_pylist(), parts, total, distinct)
        rows = []
        asked, place = np.zeros((2, 0), np.int64)
        if order <= orders:
            asked, place, task, columns = chunk.advance(order, priors, tasks)
            cuts = np.append(_starts(task), len(task))
            rows = [_row(chunk.chunk, ASKED, int(task[i]), data=_question([c[i:j] for c in columns], order == orders)) for i, j in zip(cuts, cuts[1:])]
        if order >= orders:
            code, base, trained = chunk.code.astype(np.int64), np.log10(chunk.single), (chunk.known > 0).astype(np.int64)
            code[asked] = 0
            of = np.repeat(np.arange(len(chunk.sizes)), chunk.sizes)[asked]
            sums = [np.add.reduceat(v, chunk.first) for v in (trained[chunk.tokens], base[chunk.tokens], code)]
            by_place = np.argsort(place, kind="stable")
            data = [chunk.sizes, *sums, of[by_place], np.bincount(place)]
            rows.append(_row(chunk.chunk, STATE, _share(chunk.chunk, tasks), chunk.ids, chunk.held, [_packed(d) for d in data], total))
        return pa.Table.from_batches([_batch(rows, table.schema.field("ids").type.value_type)])

    return run


# A part of a trie level -------------------------------------------------------------------------


class Level:
    """Contexts, pointers and context-relative words in monotone sequences, with counts, and codes in the last order."""

    def __init__(self, context: np.ndarray, word: np.ndarray, code: np.ndarray, count: np.ndarray, other: np.ndarray):
        """Different (context, word) pairs in that order."""
        self.alphabet, letter = _unique(word)
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.zeros(0, np.int64)
        bounds = np.append(first, len(context))
        widths = letter[bounds[1:] - 1] + 1 if len(first) else np.zeros(0, np.int64)
        base = np.cumsum(widths) - widths
        self.contexts = EliasFano(context[first])
        self.pointers = EliasFano(bounds)
        self.words = EliasFano(np.repeat(base, np.diff(bounds)) + letter + 1)
        sequences = (self.contexts, self.pointers, self.words)
        arrays = mapped([self.alphabet, code, count, other, *[a for s in sequences for a in s.arrays]])
        self.alphabet, self.code, self.count, self.other = arrays[:4]
        for k, s in enumerate(sequences):
            s.arrays = arrays[4 + 4 * k:8 + 4 * k]

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of pairs sorted by context, -1 where there is none."""
        found = np.full(len(context), -1, np.int64)
        if not self.words.size or not len(context):
            return found
        new = np.append(True, context[1:] != context[:-1])
        place, known = self.contexts.successor(context[new])
        place = np.where(known, place, 0)
        start, stop = self.pointers.access(place), self.pointers.access(place + 1)
        base = np.where(start > 0, self.words.access(np.maximum(start - 1, 0)), 0)
        of = np.cumsum(new) - 1
        letter = np.minimum(np.searchsorted(self.alphabet, word), len(self.alphabet) - 1)
        at, equal = self.words.successor(base[of] + letter + 1)
        good = known[of] & equal & (at >= start[of]) & (at < stop[of]) & (self.alphabet[letter] == word)
        found[good] = at[good]
        return found


def _level(order: int, orders: int, priors: tuple):
    """Build the part of a level and answer what the chunks ask of it.

    Below the last order: the training count, what matters of other occurrences, the step to the place of what occurs twice or more;
    a chunk works out the probabilities from the counts. The last order: the probability.
    """
    prior = _prior(priors, order)
    last = order >= orders

    def run(table: pa.Table) -> pa.Table:
        passed, asked = _asked(table)
        if not asked:
            return passed
        questions = [_read_question(r["data"]) for r in asked]
        contexts, rows, word, trained, held, code, before = (np.concatenate(c) for c in zip(*questions))
        # A pair is one number: the place of its context in their order, then its word.
        contexts, context = _unique(contexts)
        bits = int(word.max()).bit_length()
        sort, key = _sorted(np.repeat(context, rows) << bits | word, len(contexts) << bits)
        first = _starts(key)
        context, word = contexts[key[first] >> bits], key[first] & (1 << bits) - 1
        inverse = np.empty(len(sort), np.int64)
        inverse[sort] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(sort))))
        count = np.add.reduceat(trained[sort], first)
        other = np.add.reduceat(held[sort], first)
        kept = count > 0
        of = sort[first][kept]
        codes = _smoothed(count[kept], code[of], before[of], prior) if last else np.zeros(0, np.uint16)
        level = Level(context[kept], word[kept], codes, count[kept], other[kept])
        # Each different n-gram is searched once, for all chunks that ask for it.
        places = level.find(context, word)[inverse]
        cuts = np.cumsum([len(q[2]) for q in questions])
        rows = []
        for r, place, (*_, code, before) in zip(asked, np.split(places, cuts[:-1]), questions):
            hit = place >= 0
            found = place[hit]
            if not last:
                count, other = np.zeros((2, len(place)), np.int64)
                count[hit], other[hit] = level.count[found], _others(level.count[found], level.other[found])
                often = place[count + other > 1]
                often = often[often >= 0]
                data = [count, other, np.diff(often, prepend=0)]
            else:
                answer = _smoothed(0, code, before, prior)
                answer[hit] = level.code[found]
                data = [answer]
            rows.append(_row(r["chunk"], order, r["part"], data=[_packed(d) for d in data]))
        return _with(passed, rows, table)

    return run


_SCORES = [("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
           ("base_score", pa.float64()), ("score", pa.float64())]


def _scored(table: pa.Table) -> pa.Table:
    """Add the answers of the last order to the sums of the documents."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["part"]))
    state, answers = rows[0], rows[1:]
    sizes, known, code, of, times = (_unpacked(state["data"][k]) for k in (0, 1, 3, 4, 5))
    if answers:
        given = np.concatenate([_unpacked(r["data"][0], np.uint16) for r in answers])
        code = code + np.bincount(of, np.repeat(given, times), len(sizes)).astype(np.int64)
    columns = [state["held"], sizes, known, np.full(len(sizes), state["n"]), _unpacked(state["data"][2], np.float64), code / -STEPS]
    id_type = table.schema.field("ids").type.value_type
    return pa.table([pa.array(state["ids"], id_type), *[pa.array(c, t) for c, (_, t) in zip(columns, _SCORES)]],
                    ["id", *[n for n, _ in _SCORES]])


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", orders: int = ORDER,
                priors: tuple = PRIORS) -> DataFrame:
    """A row per document: ``held_out``, token counts, ``base_score`` of single words and ``score`` of the model.

    ``held_out`` is a condition on the documents; those it does not hold for (or is null for) train the model. Scores
    are decimal logarithms. The number of training tokens and of different ones is added to what the chunks know.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"chunk bigint, ids array<{id_type}>, {_TAIL}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    table = rows.mapInArrow(_chunks(parts), schema).groupBy("part").applyInArrow(_word_level(parts), schema)
    # What a chunk knows is dealt by chunk once: the totals and all orders share this exchange.
    known = table.repartition(parts, "chunk")
    totals = known.mapInArrow(_counted, "total bigint, different bigint").agg(F.array(F.sum("total"), F.sum("different")))
    known = known.withColumn("totals", totals.scalar())
    for order in range(2, max(orders, 2) + 1):
        asked = known.groupBy("chunk").applyInArrow(_asking(order, orders, priors, parts), schema)
        answers = asked.groupBy("part").applyInArrow(_level(order, orders, priors), schema)
        known = known.unionByName(answers.repartition(parts, "chunk"), allowMissingColumns=True)
    kinds = f"id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return answers.groupBy("chunk").applyInArrow(_scored, kinds).withColumnRenamed("id", id_col)


def fold_held_out(id_col: str = "doc_id"):
    """The condition of the contract: the checksum of the id leaves a remainder of one."""
    return F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_OUT
