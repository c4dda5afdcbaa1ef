"""Quality rules: boosted trees over statistics of a text, trained on labelled documents.

The trees are grown here on histograms, with monotonic constraints: more symbols, more repetition
or more capitals never raise a score. They are flattened into node arrays, and a batch of texts is
scored by walking all trees at once with numpy.

Defined results: a null or empty text has no words and fails the base rules; repeated rows and ties
score alike; an empty table gives an empty one; without labels of both kinds no tree is grown and
only the base rules reject; other columns, whatever their names, are kept by ``filter_quality``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark.llm.common import byte_texts, seeded_share

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# The model is fitted on all labelled rows, or so many of them on average, by seeded hashes.
SAMPLE_ROWS = 20_000

# A document stays when the trees give it at least this probability of being good.
KEEP_PROBABILITY = 0.5

# What the trees read, and the direction in which each may move a score (-1: only down, 0: free).
FEATURES = {
    "n_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "capital_share": -1, "digit_share": 0, "distinct_share": 0, "end_share": 0, "line_words": 0,
    "symbol_word_share": -1, "shouted_share": -1,
}

_CONTINUATION = bytes(range(0x80, 0xC0))
_DIGITS = bytes(range(0x30, 0x3A))
_CAPITALS = bytes(range(0x41, 0x5B))
_LETTERS = _CAPITALS + bytes(range(0x61, 0x7B))
_BLANKS = b" \t\n\x0b\x0c\r"
_STOPS = (b".", b"!", b"?", b",", b";", b":")

BASE = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_())]


def _among(text: bytes, members: bytes) -> int:
    return len(text) - len(text.translate(None, members))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window occurring twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n + 2)
    if len(number) == n + 2:
        return 0
    size = len(number)
    if size < 2_000_000:  # three ids fit into 63 bits
        keys = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:
        _, pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)
        keys = pairs[:-1] * size + ids[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(n, bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    covered = np.zeros(n + 2, bool)
    for shift in range(3):
        covered[shift:n + shift] |= again
    return int(covered.sum())


def statistics(text: bytes) -> tuple[tuple, tuple]:
    """The contract's counts, and the features of the trees, of one whole text."""
    words = text.split()
    n = len(words)
    characters = len(text) - _among(text, _CONTINUATION)
    word_chars = characters - _among(text, _BLANKS)
    symbols = _among(text, SYMBOLS)
    seen: set[bytes] = set()
    lines = again = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            again += line in seen
            seen.add(line)
    repeats = repeated_words(words)
    base = (n, word_chars, symbols, again, repeats, n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n)
    letters = _among(text, _LETTERS)
    of = max(n, 1)
    marks = bytes(SYMBOLS[:5]) + b"!"
    features = (
        n, word_chars / of, symbols / max(word_chars, 1), again / max(lines, 1), repeats / of,
        _among(text, _CAPITALS) / max(letters, 1), _among(text, _DIGITS) / max(word_chars, 1),
        len(set(words)) / of, sum(w.endswith(_STOPS) for w in words) / of, n / max(lines, 1),
        sum(w[-1] in SYMBOLS for w in words) / of, sum(w[-1] in marks for w in words) / of,
    )
    return base, features


@dataclass(frozen=True)
class Trees:
    """All trees in node arrays: a leaf points to itself, so a walk has a fixed number of steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def probability(self, rows: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(rows), len(self.roots))).copy()
        line = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            goes_left = rows[line, self.feature[at]] <= self.threshold[at]
            at = np.where(goes_left, self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(axis=1))))


def fit_trees(rows: np.ndarray, good: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2,
              bins: int = 64, penalty: float = 1.0, least: float = 1.0, directions=None) -> Trees | None:
    """Boosted trees for a 0/1 target, None unless both values occur.

    A split on a constrained feature is taken only if the side with larger values does not score
    higher, and the halves' scores are bounded by their middle, so the constraint holds in the tree
    as a whole and so in the sum.
    """
    directions = np.array(list(FEATURES.values()) if directions is None else directions)
    if not len(good) or good.min() == good.max():
        return None
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(rows.shape[1])]
    binned = np.stack([np.searchsorted(c, rows[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    start = float(np.log(good.mean() / (1 - good.mean())))
    score = np.full(len(good), start)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []

    def grow(members: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = slope[members], curve[members]
        total_g, total_h = g.sum(), h.sum()
        own = len(nodes)
        leaf = float(np.clip(-total_g / (total_h + penalty), low, high))
        nodes.append([0, np.inf, own, own, rate * leaf])
        if level == depth:
            return own
        best = (1e-9, None)
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            left_g = np.cumsum(np.bincount(binned[members, f], g, len(cut) + 1))[:-1]
            left_h = np.cumsum(np.bincount(binned[members, f], h, len(cut) + 1))[:-1]
            left = np.clip(-left_g / (left_h + penalty), low, high)
            right = np.clip(-(total_g - left_g) / (total_h - left_h + penalty), low, high)

            def loss(v, sum_g, sum_h):
                return sum_g * v + (sum_h + penalty) * v * v / 2

            gain = loss(leaf, total_g, total_h) - loss(left, left_g, left_h) - loss(right, total_g - left_g, total_h - left_h)
            allowed = (left_h >= least) & (total_h - left_h >= least) & (directions[f] * (right - left) >= 0)
            gain = np.where(allowed, gain, 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, k, float(left[k]), float(right[k])))
        if best[1] is None:
            return own
        f, k, left, right = best[1]
        middle = (left + right) / 2
        goes_left = binned[members, f] <= k
        bounds = [(low, high), (low, high)]
        if directions[f]:
            bounds = [(low, middle), (middle, high)] if directions[f] > 0 else [(middle, high), (low, middle)]
        a = grow(members[goes_left], level + 1, *bounds[0])
        b = grow(members[~goes_left], level + 1, *bounds[1])
        nodes[own] = [f, float(cuts[f][k]), a, b, 0.0]
        return own

    for _ in range(trees):
        chance = 1 / (1 + np.exp(-score))
        slope, curve = chance - good, np.maximum(chance * (1 - chance), 1e-6)
        roots.append(grow(np.arange(len(good)), 0, -np.inf, np.inf))
        table = np.array(nodes)
        one = Trees(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4],
                    np.array(roots[-1:]), depth, 0.0)
        at = np.full(len(rows), roots[-1])
        for _ in range(depth):
            at = np.where(rows[np.arange(len(rows)), one.feature[at]] <= one.threshold[at], one.left[at], one.right[at])
        score = score + one.value[at]
    table = np.array(nodes)
    return Trees(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4],
                 np.array(roots), depth, start)


def _scored(trees: Trees | None):
    """Arrow batches (row, text) to (row, counts, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                found = [statistics(t) for t in byte_texts(batch["text"])]
                base = list(zip(*[b for b, _ in found], strict=True))
                kept = ~np.array(base[5], bool)
                probability = np.ones(len(found))
                if trees is not None:
                    probability = trees.probability(np.array([f for _, f in found], float))
                    kept &= probability >= KEEP_PROBABILITY
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], *[pa.array(v, t) for v, (_, t) in zip(base, BASE, strict=True)],
                     pa.array(kept), pa.array(probability)],
                    ["id", *[n for n, _ in BASE], "kept", "probability"],
                )

    return run


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t)[1] for t in byte_texts(batch["text"])]
        yield pa.RecordBatch.from_arrays(
            [batch["id"], batch["good"], pa.array([list(map(float, r)) for r in rows], pa.list_(pa.float64()))],
            ["id", "good", "features"],
        )


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> Trees | None:
    """Trees fitted on the labelled documents.

    All labels are taken, or ``sample_rows`` of them on average, by seeded hashes of their ids, and
    their statistics (a dozen numbers a row) are fitted in the driver. Scoring covers every row.
    """
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("good"))
        .where("id is not null and good in (0, 1)").groupBy("id").agg(F.max("good").alias("good"))
        .withColumn("draw", F.xxhash64(F.lit(seed), "id"))
    )
    chosen = seeded_share(known, "draw", sample_rows).drop("draw")
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    labelled = labelled.select("id", "good", "text")
    id_type = labels.schema[id_col].dataType.simpleString()
    rows = labelled.mapInArrow(_features, f"id {id_type}, good int, features array<double>")
    rows = rows.groupBy("id").agg(F.max("good").alias("good"), F.min("features").alias("features")).toArrow()
    if not rows.num_rows:
        return None
    values = np.array(rows["features"].to_pylist(), float)
    good = np.array(rows["good"].to_pylist(), float)
    order = np.lexsort([*values.T, good])  # the same trees, however the rows arrive
    return fit_trees(values[order], good[order])


def score_quality(docs: DataFrame, trees: Trees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id, the contract's counts, ``base_failed``, ``kept`` and ``probability``."""
    kinds = ", ".join(f"{n} {'boolean' if t == pa.bool_() else 'bigint'}" for n, t in BASE)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scored(trees), f"id {id_type}, {kinds}, kept boolean, probability double").withColumnRenamed("id", id_col)


def filter_quality(docs: DataFrame, trees: Trees | None, text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""

    @F.arrow_udf(T.BooleanType())
    def good(column: pa.Array) -> pa.Array:
        kept = np.zeros(len(column), bool)
        for first in range(0, len(column), 512):
            found = [statistics(t) for t in byte_texts(column.slice(first, 512))]
            ok = ~np.array([b[5] for b, _ in found], bool)
            if trees is not None:
                ok &= trees.probability(np.array([f for _, f in found], float)) >= KEEP_PROBABILITY
            kept[first:first + len(found)] = ok
        return pa.array(kept)

    return docs.where(good(F.col(text_col)))
