"""SimHash near-duplicates: 64-bit fingerprints compared exactly, tile by tile.

Equal fingerprints are one node, so copies cost nothing. Nodes are sorted into tiles by population
count, tiles are paired where their counts are within the radius, and a task compares the two tiles
of a pair with numpy: exclusive-or, bit counts, threshold. Inside, blocks are ordered by population
count and skipped in the same way. A task returns a spanning forest of the links it found, never all
pairs of a dense group. Components of the forests are the components of all links.

The number of comparisons grows with the square of the number of distinct fingerprints, in tasks of
equal, bounded size; that is the method's cost.

Defined results: a text without words (null, empty, blanks) has fingerprint zero, linked like any
other; a text shorter than a shingle is one shingle; repeated rows and ties share a fingerprint, and
so a component; null ids take no part in the choice of a component's id (all null: null); an empty
table gives an empty one. Only the id column and the named results are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import byte_texts, connected_components
from labelspark.session import checkpointed, settle

SEED = 42
SHINGLE = 3
RADIUS = 2
# Nodes in a tile: a task holds two tiles.
TILE_ROWS = 65_536
# Sides of a block that is compared at once, and found links after which a forest is made of them.
BLOCK = (256, 2_048)
HELD_LINKS = 1_000_000
# Parts that the nodes of one component are dealt into when they look it up.
SPREAD = 16
# Nodes with signatures, and with shingle sets, in a tile; and tiles that a smaller table is cut into.
SIGNATURE_ROWS = 262_144
SET_ROWS = 8_192
FEWEST_TILES = 8
# Shingles hashed at once.
HASHED = 1 << 16

# For similarity by shingle sets: small signatures that travel with a fingerprint.
SIGNATURE = 128
_MULTIPLIERS = (np.random.default_rng(SEED).integers(0, 1 << 63, SIGNATURE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingle_hashes(text: bytes, size: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text, repeats included, in blocks; nothing for a text without words."""
    words = text.lower().split()  # on bytes: only A-Z, cut at 0x20 and 0x09 to 0x0D
    if not words:
        return
    joined = b" ".join(words)
    if len(words) <= size:
        yield np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
        return
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    n = len(words) - size + 1
    for first in range(0, n, HASHED):
        last = min(first + HASHED, n)
        yield np.array(
            [digest(joined[a:b], seed) for a, b in zip(starts[first:last].tolist(), ends[first + size - 1:last + size - 1].tolist())],
            np.uint64,
        )


def fingerprint(blocks: list[np.ndarray]) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in blocks:
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def signature(blocks: list[np.ndarray]) -> bytes:
    """The low bytes of the minima of the hashes under fixed multipliers (all zero without words)."""
    least = np.full(SIGNATURE, ~np.uint64(0))
    for hashes in blocks:
        for first in range(0, len(hashes), 4_096):
            part = hashes[first:first + 4_096]
            least = np.minimum(least, (part[:, None] * _MULTIPLIERS).min(axis=0))
    return ((least >> np.uint64(40)) & np.uint64(255)).astype(np.uint8).tobytes() if blocks else bytes(SIGNATURE)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 signatures: bool = False, distinct: bool = False) -> DataFrame:
    """``(id, fp bigint[, signature binary])`` of every whole text; ``distinct`` counts a repeated shingle once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, signs = [], []
            for text in byte_texts(batch["text"]):
                blocks = list(shingle_hashes(text, shingle))
                if distinct and blocks:
                    blocks = [np.unique(np.concatenate(blocks))]
                found.append(fingerprint(blocks))
                if signatures:
                    signs.append(signature(blocks))
            columns = [batch["id"], pa.array(np.array(found, np.uint64).view(np.int64))]
            names = ["id", "fp"]
            if signatures:
                columns.append(pa.array(signs, pa.binary()))
                names.append("signature")
            yield pa.RecordBatch.from_arrays(columns, names)

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, fp bigint" + ", signature binary" * signatures).withColumnRenamed("id", id_col)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same nodes: everyone with the smallest of its component."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        # a node's label is a node of its own component, which may have found a smaller one
        np.minimum.at(label, before, label)
        label = label[label]
        if np.array_equal(label, before):
            break
    other = np.flatnonzero(label != np.arange(n))
    return other, label[other]


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within the radius, each once, as positions in ``left`` and in ``right``, block by block.

    With the same array on both sides, pairs within it; their first sides come before the second in one
    order of all positions.
    """
    within = left is right
    count_left, count_right = (np.bitwise_count(x).astype(np.int64) for x in (left, right))
    order_left, order_right = (np.argsort(c, kind="stable") for c in (count_left, count_right))
    a, b = left[order_left], right[order_right]
    pops_a, pops_b = count_left[order_left], count_right[order_right]
    for i in range(0, len(a), BLOCK[0]):
        block = a[i:i + BLOCK[0], None]
        # counts are sorted: only a run of the other tile can be within the radius
        low = np.searchsorted(pops_b, pops_a[i] - radius, "left")
        high = np.searchsorted(pops_b, pops_a[min(i + BLOCK[0], len(a)) - 1] + radius, "right")
        for j in range(max(low, i) if within else low, high, BLOCK[1]):
            near = np.bitwise_count(block ^ b[None, j:min(j + BLOCK[1], high)]) <= radius
            if not near.any():
                continue
            x, y = np.nonzero(near)
            x, y = x + i, y + j
            if within:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield order_left[x], order_right[y]


def compare(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as positions in ``left`` followed by ``right``, of the links between two tiles.

    With the same array on both sides, links within it.
    """
    n, shift = (len(left), 0) if left is right else (len(left) + len(right), len(left))
    links: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def reduced():
        i, j = (np.concatenate([x[k] for x in links] or [np.empty(0, np.int64)]) for k in (0, 1))
        return forest(n, i, j)

    for x, y in near_pairs(left, right, radius):
        links.append((x, y + shift))
        held += len(x)
        if held > HELD_LINKS:
            links = [reduced()]
            held = 0
    return reduced()


def best_forest(n: int, a: np.ndarray, b: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Positions of the links of a spanning forest with the highest scores: every part takes its best link
    to another part, round by round. Ties go by ``a``, then ``b``."""
    order = np.lexsort((b, a, -score))
    a, b = a[order], b[order]
    label, chosen, left = np.arange(n), np.zeros(len(a), bool), np.arange(len(a))
    while True:
        x, y = label[a[left]], label[b[left]]
        apart = x != y
        left, x, y = left[apart], x[apart], y[apart]
        if not len(left):
            return order[chosen]
        best = np.full(n, len(a))
        np.minimum.at(best, x, left)
        np.minimum.at(best, y, left)
        picked = np.unique(best[best < len(a)])
        chosen[picked] = True
        move = np.arange(n)
        other, least = forest(n, label[a[picked]], label[b[picked]])
        move[other] = least
        label = move[label]


def _tiles(counts: dict[int, int], rows: int, radius: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """For each population count 0 to 64: its first tile, its number of tiles, and the span of tiles
    that may hold links of its tiles. Small neighbouring counts share a tile."""
    first, number, tile, room = [0] * 65, [1] * 65, -1, 0
    for pop in range(65):
        n = counts.get(pop, 0)
        if n > rows:
            first[pop], number[pop], room = tile + 1, -(-n // rows), 0
            tile += number[pop]
        else:
            if n > room or tile < 0:
                tile, room = tile + 1, rows
            first[pop] = tile
            room -= n
    pops = {t: [p for p in range(65) if first[p] <= t < first[p] + number[p]] for t in range(tile + 1)}
    low, high = [0] * 65, [0] * 65
    for pop in range(65):
        mine = range(first[pop], first[pop] + number[pop])
        reach = {q for t in mine for p in pops[t] for q in range(max(0, p - radius), min(64, p + radius) + 1)}
        low[pop] = min(first[q] for q in reach)
        high[pop] = max(first[q] + number[q] - 1 for q in reach)
    return first, number, low, high


def _tiled(nodes: DataFrame, radius: int, tile_rows: int) -> DataFrame:
    """``nodes`` dealt into pairs of tiles ``(x, y)`` that may hold links."""
    counts = {r[0]: r[1] for r in nodes.groupBy(F.bit_count("fp")).count().collect()}  # 65 rows at most
    first, number, low, high = (F.array(*map(F.lit, x)) for x in _tiles(counts, tile_rows, radius))
    pop = F.bit_count("fp")
    named = nodes.withColumn("tile", first[pop] + F.pmod(F.xxhash64("fp", "node"), number[pop]).cast("int"))
    named = named.withColumn("other", F.explode(F.sequence(low[pop], high[pop])))
    return named.withColumns({"x": F.least("tile", "other"), "y": F.greatest("tile", "other")}).drop("other")


def _sides(key, table: pa.Table) -> list[pa.Table]:
    x, y = (k.as_py() for k in key)
    return [table.filter(pc.equal(table["tile"], t)).sort_by("node") for t in ([x] if x == y else [x, y])]


def _words(side: pa.Table) -> np.ndarray:
    return side["fp"].to_numpy().astype(np.int64).view(np.uint64)


def tile_links(nodes: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(a, b)``: links that connect what is within ``radius`` bits, of ``nodes (node, fp)``.

    Nodes are distinct and not null.
    """

    def run(key, table):
        sides = _sides(key, table)
        words = [_words(s) for s in sides]
        nodes = np.concatenate([s["node"].to_numpy() for s in sides])
        i, j = compare(words[0], words[-1], radius)
        return pa.table({"a": nodes[i], "b": nodes[j]})

    return _tiled(nodes, radius, tile_rows).select("x", "y", "tile", "node", "fp").groupBy("x", "y").applyInArrow(run, "a bigint, b bigint")


def _signature_pairs(sides: list[pa.Table], radius: int, least: int):
    """``(x, y, equal places)`` of the pairs of two sides that are candidates, block by block."""
    words = [_words(s) for s in sides]
    signs = [np.frombuffer(b"".join(s["signature"].to_pylist()), np.uint8).reshape(-1, SIGNATURE) for s in sides]
    for x, y in near_pairs(words[0], words[-1], radius):
        equal = np.empty(len(x), np.int64)
        for k in range(0, len(x), 65_536):
            equal[k:k + 65_536] = (signs[0][x[k:k + 65_536]] == signs[-1][y[k:k + 65_536]]).sum(axis=1)
        near = equal >= least
        if near.any():
            yield x[near], y[near], equal[near]


def candidates(nodes: DataFrame, radius: int, least: int, tile_rows: int) -> DataFrame:
    """``(a, b)``: pairs of ``nodes (node, fp, signature)`` within ``radius`` bits and with at least ``least``
    equal places of their signatures; of each pair of tiles a spanning forest of those with the most."""

    def run(key, table):
        sides = _sides(key, table)
        nodes = np.concatenate([s["node"].to_numpy() for s in sides])
        shift = 0 if len(sides) == 1 else sides[0].num_rows
        held, size = [], 0

        def reduced():
            x, y, score = (np.concatenate([h[k] for h in held] or [np.empty(0, np.int64)]) for k in range(3))
            best = best_forest(len(nodes), x, y, score)
            return x[best], y[best], score[best]

        for x, y, equal in _signature_pairs(sides, radius, least):
            held.append((x, y + shift, equal))
            size += len(x)
            if size > HELD_LINKS:
                held = [reduced()]
                size = 0
        x, y, _ = reduced()
        return pa.table({"a": nodes[x], "b": nodes[y]})

    columns = ["x", "y", "tile", "node", "fp", "signature"]
    return _tiled(nodes, radius, tile_rows).select(columns).groupBy("x", "y").applyInArrow(run, "a bigint, b bigint")


def similar_between(nodes: DataFrame, radius: int, least: int, similarity: tuple[int, int], tile_rows: int = SET_ROWS) -> DataFrame:
    """``(a, b)``: links that connect what is similar by its shingle set, of the candidates between different parts
    of one group, of ``nodes (node, fp, signature, group, part, shingles)``. A task compares the sets of two tiles
    and passes over pairs whose parts its links connect already, so it returns a forest and never all pairs."""

    def run(key, table):
        sides = _sides(key, table)
        names, groups, parts = ([s[c].to_numpy() for s in sides] for c in ("node", "group", "part"))
        sets = [[np.frombuffer(v.as_buffer(), "<u8") for v in s["shingles"].combine_chunks()] for s in sides]
        number, label = np.unique(np.concatenate(parts), return_inverse=True)
        label = [label[:len(parts[0])], label[-len(parts[-1]):]]
        root, a, b = np.arange(len(number)), [], []
        for x, y, equal in _signature_pairs(sides, radius, least):
            todo = np.flatnonzero((groups[0][x] == groups[-1][y]) & (root[label[0][x]] != root[label[1][y]]))
            for i in todo[np.argsort(-equal[todo], kind="stable")].tolist():
                p, q = root[label[0][x[i]]], root[label[1][y[i]]]
                if p != q and _similar(sets[0][x[i]], sets[-1][y[i]], similarity):
                    root[root == max(p, q)] = min(p, q)
                    a.append(names[0][x[i]])
                    b.append(names[-1][y[i]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    columns = ["x", "y", "tile", "node", "fp", "signature", "group", "part", "shingles"]
    return _tiled(nodes, radius, tile_rows).select(columns).groupBy("x", "y").applyInArrow(run, "a bigint, b bigint")


def _similar(one: np.ndarray, two: np.ndarray, similarity: tuple[int, int]) -> bool:
    """Whether two sets of distinct hashes are as similar as the fraction, or more; empty ones are not."""
    share, whole = similarity
    if not len(one) or not len(two) or whole * min(len(one), len(two)) < share * max(len(one), len(two)):
        return False
    both = len(np.intersect1d(one, two, assume_unique=True))
    return whole * both >= share * (len(one) + len(two) - both)


def _shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``(node, shingles binary)``: the sorted distinct hashes of ``texts (node, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in byte_texts(batch["text"]):
                blocks = list(shingle_hashes(text, shingle))
                found.append(np.unique(np.concatenate(blocks)).astype("<u8").tobytes() if blocks else b"")
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(found, pa.binary())], ["node", "shingles"])

    return texts.mapInArrow(run, "node bigint, shingles binary")


def confirmed(links: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The ``links (a, b)`` whose shingle sets are as similar as the fraction ``similarity``, or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sure = np.zeros(batch.num_rows, bool)
            for i, (p, q) in enumerate(zip(batch["p"], batch["q"], strict=True)):
                one, two = (np.frombuffer(s.as_buffer(), "<u8") for s in (p, q))
                sure[i] = _similar(one, two, similarity)
            yield batch.select(["a", "b"]).filter(pa.array(sure))

    named = lambda key, value: sets.select(F.col("node").alias(key), F.col("shingles").alias(value))
    return links.join(named("a", "p"), "a").join(named("b", "q"), "b").select("a", "b", "p", "q").mapInArrow(run, "a bigint, b bigint")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(id, fp, component)`` of every row; the component is the smallest id reachable over links of at
    most ``radius`` differing bits. Ids are whole numbers."""
    marked = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    nodes = checkpointed(marked.groupBy(F.col("fp").alias("node")).agg(F.min(id_col).alias("least")))
    named = _components(nodes, tile_links(nodes.withColumn("fp", F.col("node")), radius, tile_rows))
    return marked.join(named.withColumnRenamed("node", "fp"), "fp").select(id_col, "fp", "component")


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, component)`` of ``nodes (node, least)``: the smallest ``least`` of the nodes it reaches."""
    root = F.coalesce("component", "node").alias("root")
    rooted = checkpointed(nodes.join(connected_components(links), "node", "left").select("node", "least", root))
    # Components of several nodes, each in as many copies as their nodes are spread over.
    least = rooted.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("n")).where("n > 1").drop("n")
    least = least.withColumn("spread", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    rooted = rooted.withColumn("spread", F.pmod(F.xxhash64("node"), F.lit(SPREAD)))
    return rooted.join(least, ["root", "spread"], "left").select("node", F.coalesce("component", "least").alias("component"))


def similar_links(docs: DataFrame, nodes: DataFrame, shingle: int, radius: int, least: int, similarity: tuple[int, int],
                  tile_rows: int | None = None) -> DataFrame:
    """``(a, b)``: confirmed links that connect the ``nodes (node, fp, signature, least (none, id, digest))`` whose
    shingle sets in ``docs (id, digest, text)`` are similar.

    One pass over all tiles gives forests of the best candidates, whose links are confirmed. Nodes that candidates
    connect and confirmed links don't are compared once more, with their sets in the tasks. So no candidate is left
    out that could connect two parts, and no pass writes more links than it reads nodes.
    """
    rows = tile_rows or min(SIGNATURE_ROWS, max(-(-nodes.count() // FEWEST_TILES), 1))
    links = checkpointed(candidates(nodes.select("node", "fp", "signature"), radius, least, rows))
    if links.isEmpty():
        return links
    groups = checkpointed(connected_components(links).withColumnRenamed("component", "group"))
    linked = checkpointed(groups.join(nodes, "node").select("node", F.col("least.id").alias("_id"), F.col("least.digest").alias("_digest")))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    texts = docs.join(linked, same).select("node", "text")
    sets = checkpointed(_shingle_sets(texts, shingle).dropDuplicates(["node"]))
    sure = checkpointed(confirmed(links, sets, similarity))
    parts = groups.join(connected_components(sure), "node", "left").select("node", "group", F.coalesce("component", "node").alias("part"))
    parts = checkpointed(parts)
    open_ = parts.groupBy("group").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("group")
    left = checkpointed(parts.join(open_, "group").join(nodes.select("node", "fp", "signature"), "node").join(sets, "node"))
    return sure.union(checkpointed(similar_between(left, radius, least, similarity, min(rows, SET_ROWS))))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                     radius: int = 21, least: int = 84, similarity: tuple[int, int] = (4, 5), tile_rows: int | None = None) -> DataFrame:
    """One document, that with the smallest id, of each group of near-copies, with all its columns.

    Fingerprints are those of distinct shingles, as similarity is that of sets. Documents of a similarity of
    0.8 or more differ in some 10 of 64 bits, with a deviation of 3: within ``radius`` bits they are
    candidates where ``least`` places of 128-place signatures agree (102 stand for 0.8, with a deviation of 4.5). Candidates are confirmed by their exact shingle sets:
    ``similarity`` is a fraction. Texts with the same fingerprint and signature are copies. Of rows without
    an id, or rows that repeat an id and a text, one stays per group.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    node = F.xxhash64("fp", "signature")
    marked = checkpointed(
        fingerprints(docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest")).alias("row"),
                                 F.col(text_col).alias("text")), "row", "text", shingle, signatures=True, distinct=True)
        .select("row.id", "row.digest", "fp", "signature", node.alias("node"))
    )
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest"))
    nodes = checkpointed(marked.groupBy("node", "fp", "signature").agg(first.alias("least")))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    links = similar_links(texts, nodes, shingle, radius, least, similarity, tile_rows)
    # groups that hold one row are kept as they are, so every group is named by its first row
    kept = _components(nodes.select("node", "least"), links).select("component").distinct()
    kept = checkpointed(kept.select(F.col("component.id").alias("_kept_id"), F.col("component.digest").alias("_kept_digest")))
    rows = docs.withColumn("_row_digest", F.xxhash64(text))
    same = F.col(id_col).eqNullSafe(F.col("_kept_id")) & (F.col("_row_digest") == F.col("_kept_digest"))
    found = rows.join(kept, same, "left_semi")
    # Only rows that repeat an id and a text are brought together.
    again = marked.groupBy("id", "digest").count().where("count > 1")
    again = settle(again.select(F.col("id").alias("_kept_id"), F.col("digest").alias("_kept_digest")))
    if not again.small or again.table.num_rows:
        twice = found.join(again.side(), same, "left_semi").dropDuplicates([id_col, "_row_digest"])
        found = found.join(again.side(), same, "left_anti").unionByName(twice)
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])
