"""Where names may stand in running text: a filter of all names, and a scan of texts through it.

The filter is a bit field of bounded size over hashes of whole names and of their beginnings of 8, 16, 32 … characters.
It passes every name and few other strings, so what it passes is to be compared with the names themselves; a
vocabulary of any size fits, one far beyond the field only makes it pass more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The shortest beginning; shorter names are looked up at every place.
HEAD = 8
# Bits of the field for a name, and at most; places of a name.
NAME_BITS, MOST_BITS, PROBES = 256, 1 << 27, 6
# Characters hashed at once, and gathered before rows are sent on.
WINDOW, GATHERED = 1 << 18, 1 << 22

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_ROWS = "key string, segment string, places array<struct<tid: bigint, at: int>>"
_PLACE = pa.struct([("tid", pa.int64()), ("at", pa.int32())])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _string(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class Hashes:
    """Hashes of the substrings of some characters; equal strings hash alike wherever they stand."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.sums = np.zeros(n + 1, np.uint64)
        # Powers and sums are modulo 2 ** 64; dividing by a power takes the place out again.
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=self.sums[1:])
        self.back = _powers(_BACK, n)

    def of(self, at: np.ndarray, size, whole: bool) -> np.ndarray:
        x = (self.sums[at + size] - self.sums[at]) * self.back[at] ^ np.uint64(0x5851F42D4C957F2D if whole else 0)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _bits(x: np.ndarray, k: int, size: int) -> np.ndarray:
    """The k-th place of each hash in a field of ``size`` bits, a power of two."""
    return (x + np.uint64(k) * ((x >> np.uint64(32)) | np.uint64(1))) & np.uint64(size - 1)


def _cells(size: int):
    """The cells of the field that names set: ``(cell, bits)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch["key"].to_pylist()
            sizes = np.fromiter(map(len, names), np.int64, len(names))
            first = np.cumsum(sizes) - sizes
            hashes = Hashes(_points("".join(names)))
            found = [hashes.of(first, sizes, True)]
            width = HEAD
            while (long := sizes >= width).any():
                found.append(hashes.of(first[long], width, False))
                width *= 2
            x = np.unique(np.concatenate(found))
            places = np.unique(np.concatenate([_bits(x, k, size) for k in range(PROBES)]))
            cell = (places >> np.uint64(6)).astype(np.int64)
            starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            bits = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), starts).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell[starts]), pa.array(bits)], ["cell", "bits"])

    return run


class Filter:
    """The bit field and the lengths of the names."""

    def __init__(self, cells: np.ndarray, lengths: list[int]):
        self.cells, self.lengths = cells, sorted(lengths)

    def passes(self, x: np.ndarray) -> np.ndarray:
        """Places in ``x`` of the hashes that may be of names."""
        left = np.arange(len(x))
        for k in range(PROBES):
            at = _bits(x[left], k, len(self.cells) * 64)
            left = left[(self.cells[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)]
        return left

    def places(self, points: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Beginnings and lengths of what may be names; one that begins at ``i`` ends by ``stop[i]``."""
        starts, sizes = [], []
        most = self.lengths[-1]
        for begin in range(0, len(points), WINDOW):
            hashes = Hashes(points[begin:begin + WINDOW + most])
            room = stop[begin:begin + WINDOW] - begin
            at, width = np.arange(len(room)), 1
            while width <= most and len(at):
                if width >= HEAD:
                    at = at[room[at] >= at + width]
                    at = at[self.passes(hashes.of(at, width, False))]
                for n in self.lengths:
                    if width <= n < 2 * width:
                        own = at[room[at] >= at + n]
                        own = own[self.passes(hashes.of(own, n, True))]
                        starts.append(own + begin)
                        sizes.append(np.full(len(own), n))
                width *= 2
        return (np.concatenate(starts), np.concatenate(sizes)) if starts else (np.zeros(0, np.int64),) * 2


def name_filter(names: DataFrame) -> Filter | None:
    """The filter of ``names (key)``, none without names. Not more than the field reaches the driver."""
    lengths = {n: count for n, count in names.groupBy(F.char_length("key")).count().collect()}
    if not lengths:
        return None
    size = 1 << min(max(64, NAME_BITS * sum(lengths.values())), MOST_BITS).bit_length() - 1
    cells = names.select("key").mapInArrow(_cells(size), "cell bigint, bits bigint").groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    table = cells.toArrow()
    field = np.zeros(size // 64, np.uint64)
    field[table["cell"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return Filter(field, list(lengths))


def _found(found: Filter, tids: list[int], texts: list[str]) -> pa.RecordBatch:
    """What may be names in the texts, each once with its places."""
    whole = "".join(texts)
    letters = _points(whole)
    places = np.flatnonzero(letters != ord(" "))
    plain = letters[places]
    ends = np.searchsorted(places, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))
    begins = np.append(0, ends[:-1])
    of = np.repeat(np.arange(len(texts)), ends - begins)
    at, size = found.places(plain, ends[of])
    joined = _string(plain)
    first, last = places[at], places[at + size - 1] + 1
    rows: dict[tuple[str, str | None], list[int]] = {}
    for i, (a, n, b, e) in enumerate(zip(at.tolist(), size.tolist(), first.tolist(), last.tolist())):
        rows.setdefault((joined[a:a + n], whole[b:e] if e - b > n else None), []).append(i)
    order = np.fromiter((i for r in rows.values() for i in r), np.int64, len(at))
    text = of[at[order]]
    place = pa.StructArray.from_arrays(
        [pa.array(np.array(tids, np.int64)[text]), pa.array((at[order] - begins[text]).astype(np.int32))], fields=list(_PLACE))
    offsets = np.cumsum([0, *map(len, rows.values())])
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in rows], pa.string()), pa.array([s for _, s in rows], pa.string()),
         pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), place)], ["key", "segment", "places"])


def candidates(texts: DataFrame, found: Filter) -> DataFrame:
    """``(key, segment, places)``: what may be a name in ``texts (tid, text)``, with the texts and places it begins at.

    Places count, and keys have, no blanks; ``segment`` is the key with its blanks, null where it has none. A row is
    for some texts that lie together; a key comes in many.
    """
    shared = texts.sparkSession.sparkContext.broadcast((found.cells, found.lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(*shared.value)
        tids, gathered, size = [], [], 0
        for batch in batches:
            for tid, text in zip(batch["tid"].to_pylist(), batch["text"].to_pylist()):
                tids.append(tid)
                gathered.append(text)
                size += len(text)
                if size >= GATHERED:
                    yield _found(own, tids, gathered)
                    tids, gathered, size = [], [], 0
        if tids:
            yield _found(own, tids, gathered)

    return texts.select("tid", "text").mapInArrow(run, _ROWS)
