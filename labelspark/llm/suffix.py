"""Removal of passages that occur earlier: collection suffix order, built column by column.

A byte goes if a string of ``LENGTH`` bytes over it also starts earlier, in a document of smaller id
or before in its own. The corpus is brought to bounded collections without losing such a string:

* Every window of ``LENGTH`` bytes has an anchor, the smallest of its hashed short substrings. Equal
  windows have equal anchors, so runs of windows with one anchor (*segments*) meet by its hash.
* Equal segments are collapsed first, within a task and then over all: each but the first is a
  repeat. Anchors with one segment left are done.
* The other segments are cut from the texts and go, by anchor, to tasks that order their suffixes.

A task orders a collection of segments by multi-document construction: every round puts one symbol
in front of every segment, from its end, finds the places of the new suffixes by the previous
Burrows-Wheeler transform, and merges symbols and common prefixes into files that are read and
written from front to back. In the end, windows lie side by side where their common prefix reaches
``LENGTH``, and all but the earliest of such a run are repeats.

An anchor with more than ``HOT`` different segments is not gathered in a task: its windows are
compared one by one by 128-bit digests, collapsed in the same two steps.

Defined results: a null text is empty; nothing is removed from texts shorter than ``LENGTH``; rows
without an id come last, ordered by a digest of their texts, as are different texts under one id;
rows that repeat both id and text are one document, and each gets its result; an empty table gives
an empty one. Ids are whole numbers; only the id and text columns are read.
"""

from __future__ import annotations

import itertools
import os
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.session import checkpointed

LENGTH = 100
ANCHOR = 24  # bytes of an anchor, three words of eight
HOT = 2_000
STEP = 11  # divides the 77 places that an anchor may have in a window
# Bytes that are searched for anchors at once, and segments whose suffixes are ordered at once.
CHUNK_BYTES = 4 << 20
PIECE_BYTES = 8 << 20
COLLECTION = 16_384
_NO_ID = (1 << 63) - 1

_RUNS = "h bigint, seg bigint, id bigint, dig bigint, start bigint, n int"


def substring_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``ANCHOR`` bytes at every place."""
    n = len(data)
    words = np.empty(n - 7, np.uint64)
    for shift in range(8):
        count = (n - shift) // 8
        words[shift::8] = np.frombuffer(data, "<u8", count, shift)[:len(words[shift::8])]
    a, b, c = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    m = n - ANCHOR + 1
    key = words[:m] * a
    key ^= key >> np.uint64(29)
    key += words[8:8 + m]
    key *= b
    key ^= key >> np.uint64(32)
    key += words[16:16 + m]
    key *= c
    key ^= key >> np.uint64(31)
    key *= a
    return key


def anchors(hashes: np.ndarray) -> np.ndarray:
    """For every window of ``LENGTH`` bytes the place of its anchor, from the hashes of at most 2**24 places."""
    # The upper bits of a hash and then its place, so that the leftmost of equals counts.
    key = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    width, reach = 1, LENGTH - ANCHOR + 1
    while 2 * width <= reach:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < reach:
        rest = reach - width
        key = np.minimum(key[:-rest], key[rest:])
    return (key & np.uint64(0xFFFFFF)).astype(np.int64)


def collapse(h, seg, id_, dig, start, n):
    """Positions of the first of equal ``(h, seg)``, and of its other occurrences; rows that agree in all
    columns count once."""
    order = np.lexsort((start, dig, id_, seg, h))
    h, seg, id_, dig, start = (x[order] for x in (h, seg, id_, dig, start))
    same = np.zeros(len(order), bool)
    same[1:] = (h[1:] == h[:-1]) & (seg[1:] == seg[:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] = same[1:] & (id_[1:] == id_[:-1]) & (dig[1:] == dig[:-1]) & (start[1:] == start[:-1])
    return order[~same], order[same & ~twice]


def _batch(*columns) -> pa.RecordBatch:
    names = ["h", "seg", "id", "dig", "start", "n"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _runs(h, seg, id_, dig, start, n) -> pa.RecordBatch:
    """Collapsed runs of windows: the first of equals, and repeats with a negative number of windows.

    Repeats are spread by their place, and the runs of a document that touch are one.
    """
    first, other = collapse(h, seg, id_, dig, start, n)
    o_id, o_dig, o_start, o_n = merged(id_[other], dig[other], start[other], n[other])
    spread = (o_start * 1_000_003) ^ o_id
    return _batch(
        np.concatenate([h[first], spread]), np.concatenate([seg[first], spread]), np.concatenate([id_[first], o_id]),
        np.concatenate([dig[first], o_dig]), np.concatenate([start[first], o_start]), np.concatenate([n[first], -o_n]),
    )


def merged(id_, dig, start, n):
    """Runs of windows of the same document that touch or overlap, as one (up to 2**30 windows)."""
    if not len(id_):
        return id_, dig, start, n
    order = np.lexsort((start, dig, id_))
    id_, dig, start, n = id_[order], dig[order], start[order], n[order].astype(np.int64)
    new = np.ones(len(id_), bool)
    document = np.cumsum(np.concatenate([[True], (id_[1:] != id_[:-1]) | (dig[1:] != dig[:-1])]))
    # ends grow within a document; an offset by document keeps documents apart
    gap = int((start + n).max()) + 2
    reach = np.maximum.accumulate(start + n + document * gap)
    new[1:] = start[1:] + document[1:] * gap > reach[:-1]
    firsts = np.flatnonzero(new)
    lasts = np.concatenate([firsts[1:], [len(id_)]]) - 1
    ends = reach[lasts] - document[firsts] * gap
    return id_[firsts], dig[firsts], start[firsts], ends - start[firsts]


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of every document, collapsed within chunks of documents."""
    held: list[tuple[int, int, int, bytes]] = []  # id, digest, where the piece starts, piece
    size = 0

    def flush() -> pa.RecordBatch:
        data = np.frombuffer(b"".join(p for *_, p in held) + bytes(8), np.uint8)
        lengths = np.array([len(p) for *_, p in held])
        ends = np.cumsum(lengths)
        begins = ends - lengths
        hashes = substring_hashes(data)
        place = anchors(hashes)
        owner = np.repeat(np.arange(len(held)), lengths)[:len(place)]
        at = np.arange(len(owner))
        valid = at + LENGTH <= ends[owner]
        place = np.where(valid, place[:len(owner)], -1)
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]))
        stop = np.concatenate([new[1:], [len(owner)]])
        good = place[new] >= 0
        new, stop = new[good], stop[good]
        whole = memoryview(data)
        h = hashes[place[new]].view(np.int64)
        seg = np.array([xxhash.xxh3_64_intdigest(whole[a:b], 1) for a, b in zip(new.tolist(), (stop + LENGTH - 1).tolist())],
                       np.uint64).view(np.int64)
        of = owner[new]
        ids = np.array([x[0] for x in held], np.int64)[of]
        digs = np.array([x[1] for x in held], np.int64)[of]
        start = new - begins[of] + np.array([x[2] for x in held], np.int64)[of]
        return _runs(h, seg, ids, digs, start, stop - new)

    for batch in batches:
        for id_, dig, text in zip(batch["id"].to_pylist(), batch["dig"].to_pylist(), batch["text"], strict=True):
            view = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
            for first in range(0, max(len(view) - LENGTH + 1, 0), PIECE_BYTES):
                piece = bytes(view[first:first + PIECE_BYTES + LENGTH - 1])
                held.append((id_, dig, first, piece))
                size += len(piece)
                if size >= CHUNK_BYTES:
                    yield flush()
                    held, size = [], 0
    if held:
        yield flush()


def _meet_runs(hot: int):
    """Runs sorted by anchor: ``(kind, h, id, dig, start, n)`` with 0 for repeats, 1 for segments to be
    ordered, and 2 for those of anchors with more than ``hot`` of them (all of kind 0 if ``hot`` is 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "h", "id", "dig", "start", "n"]
        kinds = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        anchor = None  # the anchor at hand, its segments so far (until they are too many), their number
        waiting: list[tuple] = []
        number = 0
        last = None  # the last row
        for batch in batches:
            columns = [batch[c].to_numpy() for c in ("h", "seg", "id", "dig", "start", "n")]
            h, seg, id_, dig, start, n = columns
            out: list[list[np.ndarray]] = []
            repeat = n < 0
            out.append([np.zeros(repeat.sum(), np.int8), h[repeat], id_[repeat], dig[repeat], start[repeat], -n[repeat]])
            keep = np.flatnonzero(~repeat)
            h, seg, id_, dig, start, n = (c[keep] for c in columns)
            if len(h):
                before = [np.concatenate([[x], c[:-1]]) for x, c in zip(last or (0, 0, 0, 0, 0), (h, seg, id_, dig, start), strict=True)]
                same_h = h == before[0]
                same = same_h & (seg == before[1])
                twice = same & (id_ == before[2]) & (dig == before[3]) & (start == before[4])
                if last is None:
                    same_h[0] = same[0] = twice[0] = False
                last = tuple(int(c[-1]) for c in (h, seg, id_, dig, start))
                again = same & ~twice
                out.append([np.zeros(again.sum(), np.int8), h[again], id_[again], dig[again], start[again], n[again]])
                if hot:
                    first = np.flatnonzero(~same)
                    # an anchor with one segment is passed over, but for the last, which may go on
                    own = h[first]
                    differs = np.concatenate([[anchor is None or len(own) and own[0] != anchor], own[1:] != own[:-1]])
                    alone = differs & np.concatenate([differs[1:], [False]])
                    for at in first[~alone[:len(first)]].tolist():
                        row = (int(h[at]), int(id_[at]), int(dig[at]), int(start[at]), int(n[at]))
                        if row[0] != anchor:
                            if number > 1 and waiting:
                                out.append(_rows(1, waiting))
                            anchor, waiting, number = row[0], [row], 1
                            continue
                        number += 1
                        waiting.append(row)
                        if number > hot:
                            out.append(_rows(2, waiting))
                            waiting = []
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(zip(*out), kinds, strict=True)], names)
        if number > 1 and waiting:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(_rows(1, waiting), kinds, strict=True)], names)

    return run


def _rows(kind: int, rows: list[tuple]) -> list[np.ndarray]:
    return [np.full(len(rows), kind, np.int8), *np.array(rows, np.int64).T]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments of a document, and runs of single windows of hot anchors."""
    kinds = [("hot", pa.bool_()), ("h", pa.int64()), ("seg", pa.int64()), ("id", pa.int64()), ("dig", pa.int64()),
             ("start", pa.int64()), ("n", pa.int32()), ("bytes", pa.binary())]
    for batch in batches:
        runs = batch["runs"]
        values = list(zip(*[f.to_pylist() for f in runs.flatten().flatten()], strict=True))
        ends = np.cumsum(runs.value_lengths().to_numpy(zero_copy_only=False)).tolist()
        begins = [0, *ends[:-1]]
        for id_, dig, text, a, b in zip(batch["id"].to_pylist(), batch["dig"].to_pylist(), batch["text"], begins, ends, strict=True):
            view = memoryview(text.as_buffer())
            cold, windows = [], []
            for kind, h, start, n in values[a:b]:
                if kind == 1:
                    cold.append((False, h, 0, id_, dig, start, n, bytes(view[start:start + n + LENGTH - 1])))
                else:
                    windows += range(start, start + n)
            for first in range(0, len(windows), 65_536):
                starts = np.array(windows[first:first + 65_536], np.int64)
                both = [np.array([xxhash.xxh3_64_intdigest(view[s:s + LENGTH], seed) for s in starts.tolist()], np.uint64).view(np.int64)
                        for seed in (2, 3)]
                size = len(starts)
                part = _runs(*both, np.full(size, id_), np.full(size, dig), starts, np.ones(size, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(part.num_rows, bool)), *part.columns, pa.nulls(part.num_rows, pa.binary())], [k for k, _ in kinds])
            if cold:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, (_, k) in zip(zip(*cold), kinds, strict=True)], [k for k, _ in kinds])


class Stored:
    """An array in two files that are written in turns, each from its beginning."""

    def __init__(self, folder: str, name: str, kind):
        self.files = [open(os.path.join(folder, f"{name}{i}"), "w+b", buffering=0) for i in (0, 1)]
        self.kind, self.size = kind, 0

    def read(self) -> np.ndarray:
        self.files[0].seek(0)
        return np.fromfile(self.files[0], self.kind, self.size)

    def write(self, array: np.ndarray) -> None:
        self.files.reverse()
        self.files[0].seek(0)
        left = memoryview(np.ascontiguousarray(array)).cast("B")
        while len(left):
            left = left[self.files[0].write(left):]
        self.size = len(array)

    def close(self) -> None:
        for file in self.files:
            file.close()


def suffix_order(strings: list[bytes], folder: str, cap: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of a collection (0 stands before a string, then the bytes that occur)
    and the common prefixes, up to ``cap``, of neighbours in its suffix order."""
    m = len(strings)
    lengths = np.array([len(s) for s in strings])
    text = np.frombuffer(b"".join(strings), np.uint8)
    used = np.flatnonzero(np.bincount(text, minlength=256))
    # A row of the files has the common prefix in its upper half and the symbol in its lower.
    kind, both, bits = (np.uint8, np.uint16, 8) if len(used) < 256 else (np.uint16, np.uint32, 16)
    number = np.zeros(256, kind)
    number[used] = np.arange(1, len(used) + 1)
    text = number[text]
    begins = np.cumsum(lengths) - lengths
    stored = Stored(folder, "rows", both)

    def before(rows: np.ndarray, length: int) -> np.ndarray:
        """The symbols in front of the suffixes of a length."""
        at = lengths[rows] - length - 1
        return np.where(at >= 0, text[np.maximum(begins[rows] + at, 0)], 0).astype(kind)

    rows = np.arange(m)  # strings that still grow, and the places of their last suffixes
    place = np.arange(m)
    stored.write(before(rows, 0).astype(both))
    length = 0
    while True:
        packed = stored.read()
        symbols, prefixes = packed.astype(kind), (packed >> both(bits)).astype(np.uint8)
        on = lengths[rows] > length
        rows, place = rows[on], place[on]
        if not len(rows):
            stored.close()
            return symbols, prefixes
        length += 1
        # Rows in order of their symbols are the suffixes that begin with these, after m empty ones.
        order = np.argsort(symbols, kind="stable")
        sizes = np.bincount(symbols, minlength=len(used) + 1)
        ended = int(sizes[0])  # rows in front of which a string begins lead nowhere
        symbol = symbols[place]
        mine = np.empty(len(place), np.int64)
        by = np.argsort(symbol, kind="stable")
        firsts, stops = np.cumsum(sizes) - sizes, np.cumsum(sizes)
        for part in np.split(by, np.flatnonzero(np.diff(symbol[by])) + 1):
            first = firsts[symbol[part[0]]]
            mine[part] = first + np.searchsorted(order[first:stops[symbol[part[0]]]], place[part])
        new = m + mine - ended
        # Common prefixes of a new suffix with its neighbours of the same first symbol: one more than
        # the least between the rows that they extend.
        size = len(symbols) + len(rows)
        padded = np.append(prefixes, np.uint8(0))

        def least(low, high):
            """The smallest prefix over rows low + 1 to high."""
            found = np.empty(len(low), np.int64)
            if len(low):
                by = np.argsort(low)  # in this order, what lies between two ranges is passed once at most
                ends = np.empty(2 * len(low), np.int64)
                ends[0::2], ends[1::2] = low[by] + 1, high[by] + 1
                found[by] = np.minimum.reduceat(padded, ends)[::2]
            return found

        with_before = mine > firsts[symbol]
        ahead = np.zeros(len(rows), np.int64)
        ahead[with_before] = 1 + least(order[mine[with_before] - 1], place[with_before])
        with_after = mine + 1 < stops[symbol]
        behind = 1 + least(place[with_after], order[mine[with_after] + 1])
        old = np.ones(size, bool)
        old[new] = False
        merged_rows = np.empty(size, both)
        merged_rows[old] = packed
        after = new[with_after] + 1
        merged_rows[after] = (merged_rows[after] & both((1 << bits) - 1)) | (np.minimum(behind, cap).astype(both) << both(bits))
        merged_rows[new] = before(rows, length).astype(both) | (np.minimum(ahead, cap).astype(both) << both(bits))
        stored.write(merged_rows)
        place = new


def repeated_windows(strings: list[bytes], windows: np.ndarray, owner: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of the windows of all strings (string after string) those that equal an earlier one, by the order of
    ``owner`` and then ``start``."""
    with tempfile.TemporaryDirectory() as folder:
        symbols, prefixes = suffix_order(strings, folder)
    m = len(strings)
    order = np.argsort(symbols, kind="stable")
    ended = len(symbols) - np.count_nonzero(symbols)
    run = np.cumsum(prefixes < LENGTH)
    # A string's first suffix is in front of which it begins; from a suffix the order leads to the next.
    last = order[:ended]
    # Which string begins there: follow the order to the empty suffixes, which are in order of strings.
    at = last.copy()
    string = np.full(m, -1)
    todo = np.arange(len(last))
    while len(todo):
        done = at[todo] < m
        string[todo[done]] = at[todo[done]]
        todo = todo[~done]
        at[todo] = order[at[todo] - m + ended]
    first = np.empty(m, np.int64)
    first[string] = last
    begins = np.cumsum(windows) - windows
    group = np.empty(int(windows.sum()), np.int64)
    at, step, on = first, 0, np.arange(m)
    while True:
        on = on[windows[on] > step]
        if not len(on):
            break
        group[begins[on] + step] = run[at[on]]
        at = at.copy()
        at[on] = order[at[on] - m + ended]
        step += 1
    of = np.repeat(np.arange(m), windows)
    place = start[of] + np.arange(len(of)) - begins[of]
    by = np.lexsort((place, owner[of], group))
    again = np.zeros(len(by), bool)
    again[by[1:]] = group[by[1:]] == group[by[:-1]]
    return again


def trimmed(rows: list[tuple]) -> list[tuple]:
    """Segments ``(h, id, dig, start, n, bytes)`` without outer windows that can't equal another's.

    Windows that hold their anchor at nearly the same place, within ``STEP`` bytes, have all but
    ``STEP`` bytes in common. Equal windows agree there, so a stretch that no other segment of the
    anchor has rules out the windows over it. ``rows`` holds all segments of its anchors.
    """
    data = b"".join(r[5] for r in rows)
    begins = np.cumsum([0, *(len(r[5]) for r in rows[:-1])])
    place = (anchors(substring_hashes(np.frombuffer(data + bytes(8), np.uint8)))[begins] - begins).tolist()
    known: Counter = Counter()
    stretches = []
    for (h, _, _, _, n, text), p in zip(rows, place, strict=True):
        own = [(h, c, text[p - c * STEP:p - c * STEP + LENGTH - STEP + 1]) for c in range(max(p - n + 1, 0) // STEP, p // STEP + 1)]
        known.update(own)
        stretches.append(own)
    found = []
    for (h, id_, dig, start, n, text), p, own in zip(rows, place, stretches, strict=True):
        shared = [c for _, c, _ in (k for k in own if known[k] > 1)]
        if shared:  # the farther the anchor from a window's start, the earlier the window
            first, last = max(p - shared[-1] * STEP - STEP + 1, 0), min(p - shared[0] * STEP + 1, n)
            found.append((h, id_, dig, start + first, last - first, text[first:last + LENGTH - 1]))
    return found


def _order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by anchor to repeated runs of windows."""

    def ordered(rows: list[tuple]) -> pa.RecordBatch:
        rows = sorted(trimmed(list(set(rows))), key=lambda r: r[1:4])
        if not rows:
            return none
        columns = [np.array(c, np.int64) for c in list(zip(*rows))[1:5]]
        id_, dig, start, n = columns
        owner = np.cumsum(np.concatenate([[0], (id_[1:] != id_[:-1]) | (dig[1:] != dig[:-1])]))
        again = np.flatnonzero(repeated_windows([r[5] for r in rows], n, owner, start))
        of = np.repeat(np.arange(len(rows)), n)
        place = start[of] + np.arange(len(of)) - (np.cumsum(n) - n)[of]
        found = merged(id_[of[again]], dig[of[again]], place[again], np.ones(len(again), np.int64))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(found, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["id", "dig", "start", "n"])

    none = pa.RecordBatch.from_arrays(
        [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int32())], ["id", "dig", "start", "n"])
    held: list[tuple] = []
    for batch in batches:
        names = ("h", "id", "dig", "start", "n", "bytes")
        for row in zip(*[batch[c].to_pylist() for c in names], strict=True):
            if len(held) >= COLLECTION and held[-1][0] != row[0]:
                yield ordered(held)
                held = []
            held.append(row)
    if held:
        yield ordered(held)


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, dig, n_bytes, spans, kept)`` from texts and their repeated runs of windows."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for whole in batches:
        for first in range(0, whole.num_rows, 512):
            batch = whole.slice(first, 512)
            sizes, spans, kept = [], [], []
            for text, runs in zip(batch["text"].to_pylist(), batch["runs"].to_pylist(), strict=True):
                text = text or b""
                found: list[dict] = []
                for start, n in sorted((r["start"], r["n"]) for r in runs or ()):
                    end = start + n + LENGTH - 1
                    if found and start <= found[-1]["end"]:
                        found[-1]["end"] = max(found[-1]["end"], end)
                    else:
                        found.append({"start": start, "end": end})
                parts, at = [], 0
                for s in found:
                    parts.append(text[at:s["start"]])
                    at = s["end"]
                parts.append(text[at:])
                sizes.append(len(text))
                spans.append(found)
                kept.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])


def _documents(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows ``(given, text)`` with the ``(id, dig)`` of their documents, and each document once.

    Different texts under one id, or without one, are told apart by 64 bits of digest. A second digest shows
    whether two of them agree in the first; then another seed is taken.
    """
    for seed in itertools.count():
        digest = lambda s: F.xxhash64(F.lit(s), F.col("given").isNull(), "text")
        keyed = rows.select("given", F.coalesce("given", F.lit(_NO_ID)).alias("id"), digest(seed).alias("dig"), "text")
        second = F.xxhash64(F.lit(-1 - seed), "text")
        groups = keyed.select("id", "dig", second.alias("other")).groupBy("id", "dig").agg(
            F.count("*").alias("rows"), (F.min("other") != F.max("other")).alias("clash"))
        several = checkpointed(groups.where("rows > 1"))
        if several.where("clash").isEmpty():
            break
    keyed = keyed.select("given", "id", "dig", F.col("text").cast("binary").alias("text"))
    if several.isEmpty():
        return keyed, keyed
    copies = keyed.join(several.select("id", "dig"), ["id", "dig"], "left_semi").dropDuplicates(["id", "dig"])
    single = keyed.join(several.select("id", "dig"), ["id", "dig"], "left_anti")
    return keyed, single.unionByName(copies)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``(id, n_bytes, spans, kept)`` of every row: its size, the maximal removed runs of bytes, the rest."""
    rows, once = _documents(docs.select(F.col(id_col).cast("bigint").alias("given"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    in_order = ["h", "seg", "id", "dig", "start"]
    found = once.mapInArrow(_find_runs, _RUNS).repartition("h").sortWithinPartitions(*in_order)
    kinds = "kind tinyint, h bigint, id bigint, dig bigint, start bigint, n int"
    met = checkpointed(found.mapInArrow(_meet_runs(hot), kinds))
    wanted = met.where("kind > 0").groupBy("id", "dig").agg(F.collect_list(F.struct("kind", "h", "start", "n")).alias("runs"))
    cut = checkpointed(once.join(wanted, ["id", "dig"]).select("id", "dig", "text", "runs").mapInArrow(
        _cut, "hot boolean, h bigint, seg bigint, id bigint, dig bigint, start bigint, n int, bytes binary"))
    ordered = cut.where("not hot").select("h", "id", "dig", "start", "n", "bytes").repartition("h").sortWithinPartitions("h")
    ordered = ordered.mapInArrow(_order, "id bigint, dig bigint, start bigint, n int")
    single = cut.where("hot").drop("hot", "bytes").repartition("h").sortWithinPartitions(*in_order).mapInArrow(_meet_runs(0), kinds)
    runs = ["id", "dig", "start", "n"]
    repeats = met.where("kind = 0").select(runs).union(ordered).union(single.where("kind = 0").select(runs))
    lists = repeats.groupBy("id", "dig").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    kept = rows.join(lists, ["id", "dig"], "left").select(F.col("given").alias("id"), "text", "runs").mapInArrow(
        _keep, "id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return kept.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)
