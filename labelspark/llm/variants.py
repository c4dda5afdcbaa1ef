"""Spelling variants: words one edit apart, and the frequent form of each.

Letters are hashed to a few symbols. The full one-edit neighbourhood of each reduced word is generated, as
numbers to the base of the symbols, and joined with the reduced vocabulary; original words of reduced words
that meet are compared by their edit distance. An edit of a word changes its reduced word by that edit or not
at all, so no pair of words is missed, and only reduced words that meet cost a comparison.

Numbers are exact up to 20 symbols. Beyond, they are taken modulo 2**64: words that meet by chance fail the
comparison, like all others that only look alike.

Defined results: null and empty texts have no words; a very long word has as many neighbours as any, per
letter; of equally frequent forms the first by code points counts; repeated rows count each time; rows without
an id keep their words whole; an empty table gives an empty one; other columns, whatever their names, are
left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import byte_texts
from labelspark.session import checkpointed

# Fixed values of the contract.
LEAST_LETTERS = 7
LEAST_COUNT = 2
TYPO_EVERY = 31
FORM_TIMES = 10

# Letters become so many symbols (an even number); more of them let fewer words meet and make more neighbours.
SYMBOLS = 8
# Reduced words of a join group on average: some 45 neighbours each.
GROUP_WORDS = 40_000

# Texts are cut by their bytes: the letters U+00C0 to U+00FF are C3 80 to C3 BF.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % LEAST_LETTERS)
_HELD_WORDS = 1 << 18
_SLICE_LETTERS = 200_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(word, n)`` of a task's documents; a quarter of a million words are held, and those of one more text."""
    counts: Counter[str] = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc, text in zip(batch["id"].to_pylist(), byte_texts(batch["text"])):
            start = zlib.crc32(f"{doc}:".encode())
            for run, n in Counter(_RUN.findall(text.lower())).items():
                word = run.decode()
                if doc is not None and not (h := zlib.crc32(run, start)) % TYPO_EVERY:
                    place = h % len(word)
                    word = word[:place] + word[place + 1:]
                    if len(word) < LEAST_LETTERS:
                        continue
                counts[word] += n
            if len(counts) > _HELD_WORDS:
                yield rows()
                counts.clear()
    yield rows()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)``: words of seven letters or more that occur twice or more in all documents.

    A run of letters that a checksum of id and run picks loses one letter, as the contract states.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(_counted, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _digits(words: list[str], symbols: int) -> np.ndarray:
    """The symbols, from 1 on, of all letters in turn."""
    table = np.array([zlib.crc32(bytes([c])) % symbols + 1 for c in range(256)], np.uint64)
    return table[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]


class _Reduced:
    """Words of a batch as numbers to the base ``symbols + 1``, the first symbol being the lowest digit."""

    def __init__(self, words: list[str], symbols: int):
        self.symbols = symbols
        self.digit = _digits(words, symbols)
        size = np.array([len(w) for w in words], np.int64)
        self.word = np.repeat(np.arange(len(words)), size)
        self.begin = np.cumsum(size) - size
        self.place = np.arange(len(self.digit)) - self.begin[self.word]
        longest = int(size.max()) if len(size) else 0
        self.power = np.cumprod(np.append(np.uint64(1), np.full(longest + 1, symbols + 1, np.uint64)))
        part = self.digit * self.power[self.place]
        sums = np.append(np.uint64(0), np.cumsum(part))
        self.before = sums[:-1] - sums[self.begin[self.word]]
        self.key = sums[self.begin + size] - sums[self.begin]
        self.size, self.part = size, part

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """``(word, number)`` of each different reduced word one edit away or none."""
        base, word = np.uint64(self.symbols + 1), self.word
        whole = self.key[word]
        after = whole - self.before - self.part
        weight = self.power[self.place]
        back = np.uint64(pow(self.symbols + 1, -1, 1 << 64))
        ends = np.ones(len(word), bool)  # of equal symbols in a row the last one is deleted
        ends[:-1] = (self.digit[1:] != self.digit[:-1]) | (word[1:] != word[:-1])
        found = [(np.arange(len(self.key)), self.key), (word[ends], (self.before + after * back)[ends])]
        starts = self.place == 0
        earlier = np.append(np.uint64(0), self.digit[:-1])
        all_words, top = np.arange(len(self.key)), self.power[self.size]
        last = self.digit[self.begin + self.size - 1] if len(self.key) else self.digit
        for s in range(1, self.symbols + 1):
            symbol = np.uint64(s)
            other = self.digit != symbol
            found.append((word[other], (whole + (symbol - self.digit) * weight)[other]))
            first = starts | (earlier != symbol)  # beside an equal symbol it is inserted before the first one only
            found.append((word[first], (self.before + symbol * weight + (whole - self.before) * base)[first]))
            final = last != symbol
            found.append((all_words[final], (self.key + symbol * top)[final]))
        return np.concatenate([w for w, _ in found]), np.concatenate([n for _, n in found])


def _slices(words: list[str]) -> Iterator[slice]:
    start = size = 0
    for i, w in enumerate(words):
        if size and size + len(w) > _SLICE_LETTERS:
            yield slice(start, i)
            start, size = i, 0
        size += len(w)
    if words:
        yield slice(start, len(words))


def _with_key(symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch["word"].to_pylist()
            for part in _slices(words):
                key = _Reduced(words[part], symbols).key.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch["word"].slice(part.start, len(key)), batch["n"].slice(part.start, len(key)), pa.array(key)],
                    ["word", "n", "key"])

    return run


def _group(keys: np.ndarray, groups: int) -> np.ndarray:
    mixed = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(groups)).astype(np.int64)


def _packed(numbers: np.ndarray) -> bytes:
    return zstandard.compress(numbers.tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), np.uint64)


def _dealt(symbols: int, groups: int):
    """Rows of a join group: the reduced words of a batch that belong to it (no ``source``), and the neighbours.

    Either of two neighbours names the other, so only the larger number names the smaller one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch["word"].to_pylist()
            for part in _slices(words):
                reduced = _Reduced(words[part], symbols)
                word, near = reduced.neighbours()
                source = reduced.key[word]
                down = near <= source
                rows = []
                for keys, of in ((np.sort(reduced.key), None), (near[down], source[down])):
                    group = _group(keys, groups)
                    order = np.lexsort([keys, group])
                    keys, group = keys[order], group[order]
                    cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else []
                    for i, j in zip(cuts, [*cuts[1:], len(group)]):
                        steps = np.append(keys[i:i + 1], np.diff(keys[i:j]))
                        rows.append((int(group[i]), _packed(steps), None if of is None else _packed(of[order[i:j]])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["part", "near", "source"])

    return run


def _met(table: pa.Table) -> pa.Table:
    """Pairs of a reduced word and a neighbour that is a reduced word, too."""
    nears, sources = table["near"].to_pylist(), table["source"].to_pylist()
    known = [np.cumsum(_unpacked(n)) for n, s in zip(nears, sources) if s is None]
    known = np.unique(np.concatenate(known)) if known else np.zeros(0, np.uint64)
    keys, others = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for n, s in zip(nears, sources):
        if s is not None and len(known):
            near = np.cumsum(_unpacked(n))
            hit = known[np.minimum(np.searchsorted(known, near), len(known) - 1)] == near
            keys.append(_unpacked(s)[hit])
            others.append(near[hit])
    return pa.table({"key": np.concatenate(keys).view(np.int64), "near": np.concatenate(others).view(np.int64)})


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``(word, n, other, other_n)``: both ways, all pairs of ``words (word, n)`` that are one edit apart."""
    keyed = checkpointed(words.select("word", "n").mapInArrow(_with_key(symbols), "word string, n bigint, key bigint"))
    groups = max(1, -(-keyed.count() // GROUP_WORDS))
    reduced = keyed.groupBy("key").agg(F.min("word").alias("word"))
    dealt = reduced.mapInArrow(_dealt(symbols, groups), "part int, near binary, source binary")
    met = dealt.groupBy("part").applyInArrow(_met, "key bigint, near bigint")
    one = met.join(keyed, "key")
    two = keyed.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("key").alias("near_key"))
    # An equal reduced word names itself once: there the words are put in order.
    new = (F.col("key") != F.col("near")) | (F.col("word") < F.col("other"))
    same = F.levenshtein(F.col("word"), F.col("other"), 1) == 1
    pairs = one.join(two, (F.col("near") == F.col("near_key")) & new & same)
    ways = F.array(
        F.struct("word", "n", "other", "other_n"),
        F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")),
    )
    return pairs.select(F.inline(ways))


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``forms (word, form)``, each round following twice as many forms.

    A form is ten times as frequent as its word, so chains are short and end.
    """
    roots = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        longer = checkpointed(roots.join(further, F.col("root") == F.col("_word"), "left").select(
            "word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")))
        roots = longer.drop("moved")
        if longer.where("moved").isEmpty():
            return roots


def spelling_forms(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of ``words (word, n)``, each word once.

    The form is the near word of largest count (ties: first by code points), if it is ten times as frequent; the root
    is where the forms of forms end.
    """
    words = checkpointed(words)
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = near_words(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    chosen = -F.col("best.less") >= FORM_TIMES * F.col("n")
    rows = checkpointed(words.join(near, "word", "left").select(
        "word", F.when(chosen, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(chosen, -F.col("best.less")).alias("form_n")))
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
