"""BPE encoding and decoding with a public vocabulary, by an index of pair occurrences.

Texts are cut at blanks into chunks, and each chunk is prepared (normalised, cut into words) as the
vocabulary file says. The new words of a batch are laid out one after another; an index holds every
adjacent pair that has a merge rank with all its positions. The smallest active rank is applied at all
its positions, which adds the pairs that arise to the index, until no pair is left. Words do not touch
one another, so short ones are at their own smallest ranks at the same time. Every distinct
chunk is encoded once per task and looked up after that, so a frequent one costs a look-up.

The vocabulary is read from a file by every task; its path is a parameter. The file must end words
with a suffix, and each merge must come after the merges that make its parts (both are checked).

Defined results: a null or empty text has no ids and decodes to an empty text; a null list of ids
decodes to an empty text; special tokens in a text become their ids; repeated rows and ties are
encoded alike; empty tables give empty tables; ids and texts are returned beside the id column only,
so other columns cannot clash.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

# Bounds on memory, not on results: chunks and words remembered in a task, words indexed at once, rows in a batch.
REMEMBERED = 400_000
REMEMBERED_WORDS = 400_000
INDEXED_WORDS = 50_000
BATCH_ROWS = 1_024
# Bytes of words that are merged side by side, in as many rounds at most.
SHORT = 32


# Characters below this one, but for two blanks, are their own canonical composition, so that a chunk
# of them is prepared by one expression; any other chunk goes through the library's own preparation.
PLAIN = regex.compile(r"[\x00-\x84\x86-\x9f\xa1-\u024f]*")
# Fixed value: the cutting pattern of the vocabulary files with word ends, and a line end between chunks.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CUT_LINES = regex.compile(CUT + r"|\n")
STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Lists:
    """A growing number of lists of ids, fetched by their numbers."""

    def __init__(self):
        self.flat = array("i")
        self.starts = array("q", [0])

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.starts.frombytes((self.starts[-1] + np.cumsum(lengths, dtype=np.int64)).tobytes())
        self.flat.frombytes(ids.astype(np.int32).tobytes())

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of lists ``at``, one list after another, and the end of each after a zero."""
        starts = np.frombuffer(self.starts, np.int64)
        lengths = np.diff(starts)[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.frombuffer(self.flat, np.int32) if len(self.flat) else np.empty(0, np.int32)
        return flat[np.arange(ends[-1]) + np.repeat(starts[:-1][at] - ends[:-1], lengths)] if len(at) else flat[:0], ends


class Encoder:
    """Chunks of text to ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        vocabulary: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.library = Tokenizer.from_file(path)
        steps = file["pre_tokenizer"]["pretokenizers"]
        self.plain = (file["normalizer"].get("normalizers") == STEPS and len(steps) == 2
                      and steps[0]["pattern"] == {"Regex": CUT} and steps[0]["invert"])
        self.bytes = byte_alphabet()
        inner = [vocabulary[c] for c, _ in sorted(self.bytes.items(), key=lambda x: x[1])]
        last = [vocabulary[c + suffix] for c, _ in sorted(self.bytes.items(), key=lambda x: x[1])]
        # The symbol of every byte within a word, then of every byte that ends one.
        self.symbols = np.array(inner + last, np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # A pair is one number; its rank and product follow.
        self.merges: dict[int, int] = {}
        self.by_rank: list[tuple[int, int, int]] = []
        made: dict[int, int] = {}
        for rank, (a, b) in enumerate(pairs):
            left, right, both = (vocabulary[x] for x in (a, b, a + b))
            if made.get(left, -1) >= rank or made.get(right, -1) >= rank or both in made:
                raise ValueError("merges must come in the order in which their parts arise")
            made[both] = rank
            self.merges[left << 32 | right] = rank
            self.by_rank.append((left, right, both))
        # The same for many pairs at once. The last rank is that of pairs without a merge.
        self.products = np.array([both for _, _, both in self.by_rank], np.int64)
        self.pairs = np.fromiter(sorted(self.merges), np.int64, len(self.merges))
        self.ranks = np.fromiter(map(self.merges.__getitem__, self.pairs.tolist()), np.int64, len(self.merges))
        self.none = len(self.by_rank)
        self.byte_ranks = self.rank(np.repeat(self.symbols[:256], 512), np.tile(self.symbols, 256))
        self.known: dict[str | bytes | int, int] = {}
        self.forget()

    def forget(self) -> None:
        """Chunks go when they are many; their words, which are fewer, stay up to a bound of their own."""
        if not self.known or len(self.known) > REMEMBERED_WORDS:
            # The end of a chunk is a word without ids.
            self.known, self.words = {"\n": 0}, _Lists()
            self.words.add(np.empty(0), np.zeros(1))
        self.number: dict[str, int] = {}
        self.chunks = _Lists()

    def prepared(self, chunks: list[str]) -> tuple[list[str], list[str | bytes | int]]:
        """The chunks in some order, and their words in that order, each chunk's followed by a line end.

        A word is its text, or its bytes after the library's preparation; a special token is its id.
        """
        plain, other = [], []
        for chunk in chunks:
            if self.plain and (chunk.isascii() or PLAIN.fullmatch(chunk)) and "<|" not in chunk:
                plain.append(chunk)
            else:
                other.append(chunk)
        words: list[str | bytes | int] = CUT_LINES.findall("\n".join([*plain, ""]).lower())
        for chunk in other:
            for part in self.cut.split(chunk) if self.cut else [chunk]:
                if part in self.special:
                    words.append(self.special[part])
                elif part:
                    part = self.library.normalizer.normalize_str(part)
                    words += [bytes(map(self.bytes.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]
            words.append("\n")
        return plain + other, words

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of every pair of symbols."""
        if not len(self.pairs):
            return np.full(len(left), self.none)
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.ranks[at], self.none)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one word after another, and the number of each word's ids."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        of = np.repeat(np.arange(len(words)), sizes)
        byte = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        byte[ends - 1] += 256
        short = np.repeat(sizes <= SHORT, sizes)
        found = [*self.merge_short(byte[short], of[short]), self.merge_long(self.symbols[byte[~short]], of[~short])]
        of, symbol = (np.concatenate(x) for x in zip(*found))
        return symbol[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))

    def merge_short(self, byte: np.ndarray, of: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """``(words, symbols)`` in some order of words; ``of`` has the word of every byte.

        The index is the rank of the pair at every place. Each round applies the smallest active rank of every word at all
        its places and ranks the pairs that arise, so the rounds are no more than a word's bytes.
        """
        symbol = self.symbols[byte]
        rank = np.full(len(of), self.none)
        within = np.flatnonzero(of[1:] == of[:-1])
        rank[within] = self.byte_ranks[byte[within] * 512 + byte[within + 1]]
        done = [(of[:0], symbol[:0])]
        while len(of):
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(of))))
            active = least < self.none
            done.append((of[~active], symbol[~active]))
            of, symbol, rank = of[active], symbol[active], rank[active]
            at = np.flatnonzero(rank == least[active])
            # Places that overlap, in a run of one symbol: every second one.
            turn = np.arange(len(at))
            turn -= np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, turn, 0))
            at = at[turn % 2 == 0]
            symbol[at] = self.products[rank[at]]
            left = np.ones(len(of), bool)
            left[at + 1] = False
            of, symbol, rank = of[left], symbol[left], rank[left]
            at -= np.arange(len(at))
            at = np.concatenate([at, at[at > 0] - 1])
            rank[at] = self.none
            at = at[at + 1 < len(of)]
            at = at[of[at] == of[at + 1]]
            rank[at] = self.rank(symbol[at], symbol[at + 1])
        return done

    def merge_long(self, symbols: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(words, symbols)``; all words share one index from pairs to their places, smallest rank first."""
        symbol = symbols.tolist()
        places_of = np.arange(len(of))
        same = of[1:] == of[:-1]
        follows = np.where(np.append(same, False), places_of + 1, -1).tolist()[:len(of)]
        before = np.where(np.append(False, same), places_of - 1, -1).tolist()[:len(of)]
        merges, by_rank = self.merges, self.by_rank
        index: dict[int, list[int]] = {}
        for at, (left, right, after) in enumerate(zip(symbol, symbol[1:], follows)):
            if after >= 0:
                rank = merges.get(left << 32 | right)
                if rank is not None:
                    if rank in index:
                        index[rank].append(at)
                    else:
                        index[rank] = [at]
        active = list(index)
        heapq.heapify(active)
        while active:
            least = heapq.heappop(active)
            left, right, both = by_rank[least]
            places = index.pop(least)
            places.sort()
            for at in places:
                after = follows[at]
                if after < 0 or symbol[at] != left or symbol[after] != right:
                    continue  # an earlier merge has taken one of the two
                symbol[at] = both
                symbol[after] = -1
                beyond = follows[at] = follows[after]
                if beyond >= 0:
                    before[beyond] = at
                    rank = merges.get(both << 32 | symbol[beyond])
                    if rank is not None:
                        if rank in index:
                            index[rank].append(at)
                        else:
                            index[rank] = [at]
                            heapq.heappush(active, rank)
                ahead = before[at]
                if ahead >= 0:
                    rank = merges.get(symbol[ahead] << 32 | both)
                    if rank is not None:
                        if rank in index:
                            index[rank].append(ahead)
                        else:
                            index[rank] = [ahead]
                            heapq.heappush(active, rank)
        symbols = np.array(symbol, np.int64)
        left_over = symbols >= 0
        return of[left_over], symbols[left_over]

    def learn(self, chunks: list[str]) -> None:
        """Remember the ids of chunks not seen so far."""
        chunks, words = self.prepared(chunks)
        known, number = self.known, self.number
        new = [w for w in dict.fromkeys(words) if w not in known]
        for first in range(0, len(new), INDEXED_WORDS):
            part = [w for w in new[first:first + INDEXED_WORDS] if w.__class__ is not int]
            known.update(zip(part, count(len(known))))
            self.words.add(*self.encode_words([w.encode() if w.__class__ is str else w for w in part]))
        special = [w for w in new if w.__class__ is int]
        known.update(zip(special, count(len(known))))
        self.words.add(np.array(special), np.ones(len(special)))
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        ids, ends = self.words.take(at)
        number.update(zip(chunks, count(len(number))))
        self.chunks.add(ids, np.diff(ends[:-1][at == 0], prepend=0))

    def encode(self, texts: list[bytes] | pa.Array) -> pa.ListArray:
        """Ids of every text; none for a null text."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())
        pieces = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.string()), ""))
        different = pieces.flatten().dictionary_encode()
        chunks = different.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.number) > REMEMBERED:
            self.forget()
        number = self.number
        new = [c for c in chunks if c not in number]
        if new:
            self.learn(new)
        at = np.fromiter(map(number.__getitem__, chunks), np.int64, len(chunks))
        ids, ends = self.chunks.take(at[np.asarray(different.indices)])
        offsets = ends[np.asarray(pieces.offsets) - pieces.offsets[0].as_py()]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


class Decoder:
    """Ids to text: their tokens, special ones included, joined by one blank.

    That is how a vocabulary file without a decoder of its own is decoded; others are refused. An id
    outside the vocabulary has no token and is left out.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        if file.get("decoder"):
            raise ValueError("the vocabulary has a decoder of its own")
        named = {i: t for t, i in file["model"]["vocab"].items()} | {t["id"]: t["content"] for t in file["added_tokens"]}
        self.tokens = pa.array([named.get(i) for i in range(max(named) + 1)], pa.string())

    def decode(self, lists: pa.ListArray) -> pa.StringArray:
        values = lists.flatten().to_numpy(zero_copy_only=False)
        known = (values >= 0) & (values < len(self.tokens))
        lengths = np.array(pc.fill_null(pc.list_value_length(lists), 0))
        if not known.all():
            of = np.repeat(np.arange(len(lengths)), lengths)
            values, lengths = values[known], np.bincount(of[known], minlength=len(lengths))
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
        words = pa.ListArray.from_arrays(offsets, self.tokens.take(pa.array(values)))
        return pc.binary_join(words, pa.scalar(" "))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``(id, ids array<int>)`` of every whole text, without added special tokens.

    ``decoded`` adds ``text``, decoded from the ids in the same task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = decoder = None
        for whole in batches:
            encoder = encoder or Encoder(path)
            decoder = decoder or (Decoder(path) if decoded else None)
            for first in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(first, BATCH_ROWS)
                ids = encoder.encode(batch["text"])
                columns = [batch["id"], ids] + ([decoder.decode(ids)] if decoder else [])
                yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "text"][:len(columns)])

    kinds = f"id {docs.schema[id_col].dataType.simpleString()}, ids array<int>" + ", text string" * decoded
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, kinds).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, ids, text)``: every list of ids as text, see :class:`Decoder`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = None
        for whole in batches:
            decoder = decoder or Decoder(path)
            for first in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(first, BATCH_ROWS)
                yield pa.RecordBatch.from_arrays([batch["id"], batch["ids"], decoder.decode(batch["ids"])], ["id", "ids", "text"])

    id_type = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {id_type}, ids array<int>, text string").withColumnRenamed("id", id_col)
