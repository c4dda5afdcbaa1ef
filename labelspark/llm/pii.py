"""Personal data: patterns, and terms that give a protected value away by the company they keep.

The patterns find the protected entities. Then the corpus is asked how strongly other terms reveal
them. A term ``t`` in documents with an entity ``e`` has the pointwise mutual information
``log2(p(e|t) / p(e))``, at most the information of the entity, ``-log2 p(e)``; their ratio is the
share of the entity that the term discloses. Terms above the thresholds are spans too, in every
document, as they point to the entity where it is not named: above ``REMOVE`` they are taken out, above ``GENERALISE`` they are
replaced by their class. A term needs two different texts with the entity, so copies and near-copies of
one text prove nothing; and it stands in no text without the entity, or in ``EVIDENCE`` documents with
it. All counts cover all documents, and whole documents.

Everything is built-in functions: matches are marked with a control character and the text is cut
there, which gives places in code points.

Defined results: a null or empty text has no spans; rows without an id are documents like any other;
repeated rows count as documents each and get the same spans; spans of different kinds may overlap;
empty tables give empty tables; only the id column is read beside the text, so other columns cannot
clash, and ``sanitise`` returns them untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.session import SMALL_BYTES, SMALL_ROWS, checkpointed

# Disclosed shares of an entity's information from which a term is removed or generalised,
# and the documents with the entity from which the term may occur without it too.
REMOVE = 0.95
GENERALISE = 0.85
EVIDENCE = 3
# Texts are different if so many of the minima of the hashes of their word triples are.
MINIMA = 8
DIFFERENT = 4

# Fixed patterns, in the order of the contract. Possessive repetition and the anchors before runs
# only keep long runs from being tried again from every place; the matches are the same.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
_MAY_HOLD = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_MARK, _OTHER = "\x01", "\x02"
_BETWEEN_TERMS = r"[^\p{L}\p{M}\p{N}]+"


def _holds(kind: str, match: Column) -> Column:
    """Whether a match passes the kind's test."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _entity(kind: str, match: Column) -> Column:
    """One name for all ways of writing a value."""
    if kind in ("card", "phone"):
        return F.concat(F.lit(kind + ":"), F.regexp_replace(match, "[^0-9]", ""))
    return F.concat(F.lit(kind + ":"), F.lower(match))


_SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"


def _spans(text: Column, kind: str, pattern: Column | str, test=None) -> Column:
    """Sorted spans of a kind: the text is marked around matches, cut at the marks, and measured."""
    clean = F.replace(text, F.lit(_MARK), F.lit(_OTHER))  # the same length, and no pattern reads it
    pieces = F.split(F.regexp_replace(clean, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.array().cast(f"array<{_SPAN}>").alias("spans"))

    def step(state: Column, piece: Column) -> Column:
        end = (state["at"] + F.char_length(piece)).cast("int")
        span = F.struct(state["at"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"),
                        F.lit(kind).alias("kind"), piece.alias("value")).cast(_SPAN)
        found = state["hit"] & (test(piece) if test else F.lit(True))
        spans = F.when(found, F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), (~state["hit"]).alias("hit"), spans.cast(f"array<{_SPAN}>").alias("spans"))

    return F.aggregate(pieces, start, step, lambda s: s["spans"])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, digest, base)`` of every row: a digest of its text, and its spans by the patterns.

    A span is ``(start, rank, end, kind, value)``, in code points, the end exclusive.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    none = F.array().cast(f"array<{_SPAN}>")
    found = [
        F.when(text.rlike(_MAY_HOLD[kind]), _spans(text, kind, pattern, lambda m, kind=kind: _holds(kind, m))).otherwise(none)
        for kind, pattern in PATTERNS.items()
    ]
    return rows.select("id", F.xxhash64(text).alias("digest"), F.array_sort(F.concat(*found)).alias("base"), text.alias("text"))


def _terms(part: Column) -> Column:
    return F.split(F.lower(part), _BETWEEN_TERMS, -1)


def _triples(terms: Column) -> Column:
    """Hashes of a text's word triples."""
    return F.transform(terms, lambda t, i: F.xxhash64(t, F.get(terms, i + 1), F.get(terms, i + 2)))


def _least(hashes: Column, k: int) -> Column:
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(k))))


def _two_texts() -> Column:
    """Whether the minima of a group's texts differ; two texts have equal ones as often as they share triples."""
    return sum((F.min(f"m{k}") < F.max(f"m{k}")).cast("int") for k in range(MINIMA)) >= DIFFERENT


def _holding(found: DataFrame) -> DataFrame:
    """``(id, digest, entity, terms, m0, ...)``: the terms outside of all matches, for every row and entity.

    Only entities that occur in different texts; no term can be proven for the others.
    """
    def name(s: Column) -> Column:
        named = F.lit(None).cast("string")
        for kind in PATTERNS:
            named = F.when(s["kind"] == kind, _entity(kind, s["value"])).otherwise(named)
        return named

    outside = F.aggregate("base", F.col("text"), lambda text, s: F.replace(text, s["value"], F.lit(" ")))
    rows = found.where(F.size("base") > 0).select(
        "id", "digest", F.array_distinct(F.transform("base", name)).alias("entities"), _terms(outside).alias("words"))
    least = {f"m{k}": _least(F.col("triples"), k) for k in range(MINIMA)}
    terms = F.filter(F.array_distinct("words"), lambda t: t != "")
    rows = rows.withColumns({"triples": _triples(F.col("words")), "terms": terms}).withColumns(least)
    named = checkpointed(rows.select("id", "digest", F.explode("entities").alias("entity"), "terms", *least))
    several = named.groupBy("entity").agg(_two_texts().alias("several")).where("several").select("entity")
    return named.join(several, "entity")


def _side(table: DataFrame, width: Column) -> DataFrame:
    """A written table as a join side: broadcast if it, measured whole, is within the bounds; ``width`` is about the bytes of a row."""
    rows, size = table.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(table) if rows <= SMALL_ROWS and size <= SMALL_BYTES else table


def disclosing_terms(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """``(entity, term, disclosed)``: terms that disclose at least ``GENERALISE`` of an entity.

    ``found`` is the written result of :func:`_holding`.
    """
    minima = [f"m{k}" for k in range(MINIMA)]
    held = found.select("entity", "terms", *minima)
    together = checkpointed(
        held.select("entity", F.explode("terms").alias("term"), *minima).groupBy("entity", "term")
        .agg(F.count("*").alias("together"), _two_texts().alias("several")).where("several").drop("several")
    )
    entities = held.groupBy("entity").agg(F.count("*").alias("holding"))
    candidates = checkpointed(together.select("term").distinct())
    words = docs.select(F.explode(F.array_distinct(_terms(F.col(text_col)))).alias("term"))
    side = _side(candidates, F.octet_length("term"))
    if side is not candidates:  # only these words are counted, and only their counts travel
        frequency = words.join(side, "term", "left_semi").groupBy("term").agg(F.count("*").alias("frequency"))
    else:  # counted in the tasks before the join: what travels is a vocabulary per task, not the words
        frequency = words.groupBy("term").agg(F.count("*").alias("frequency")).join(candidates, "term", "left_semi")
    rated = (
        together.join(frequency, "term").join(entities, "entity")
        .where((F.col("together") >= F.col("frequency")) | (F.col("together") >= EVIDENCE))
        .withColumn("information", -F.log2(F.col("holding") / F.lit(docs.count())))
        .withColumn("given", F.least(F.col("together") / F.col("frequency"), F.lit(1.0)))
        .withColumn("disclosed", 1 + F.log2("given") / F.col("information"))
    )
    return rated.where((F.col("information") > 0) & (F.col("disclosed") >= GENERALISE)).select("entity", "term", "disclosed")


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, digest, base, terms)`` of every row: the patterns' spans, and those of disclosing terms,
    ``(start, rank, end, kind, value)`` with the share disclosed beside each as ``(span, disclosed)``."""
    found = detect(docs, id_col, text_col)
    base = checkpointed(found.select("id", "digest", "base"))
    held = checkpointed(_holding(found))
    flagged = checkpointed(disclosing_terms(docs, held, text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.xxhash64("text"))
    # For each text, the disclosing terms that it contains.
    shares = _side(checkpointed(flagged.groupBy("term").agg(F.max("disclosed").alias("disclosed"))), F.octet_length("term") + 8)
    wanted = checkpointed(
        rows.select("id", "digest", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).join(shares, "term")
        .groupBy("id", "digest").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("term", "disclosed")))).alias("shares"))
        .select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "shares")
    )
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    # Few documents are looked up where the texts lie.
    wanted = _side(wanted, F.octet_length(F.array_join(F.map_keys("shares"), " ")) + 64)
    held = rows.join(wanted, same).dropDuplicates(["id", "digest"])
    either = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{M}\p{N}])(?:"), F.array_join(F.map_keys("shares"), "|"), F.lit(r")(?![\p{L}\p{M}\p{N}])"))
    terms = checkpointed(held.select(
        F.col("id").alias("_id"), F.col("digest").alias("_digest"),
        F.transform(
            _spans(F.col("text"), "term", either),
            lambda s: F.struct(s.alias("span"), F.coalesce(F.col("shares")[F.lower(s["value"])], F.lit(GENERALISE)).alias("disclosed")),
        ).alias("terms"),
    ))
    terms = _side(terms, F.aggregate("terms", F.lit(64).cast("long"), lambda n, t: n + F.octet_length(t["span"]["value"]) + 64))
    none = F.array().cast(f"array<struct<span:{_SPAN},disclosed:double>>")
    # a term inside a pattern's span is covered already
    outside = F.filter("terms", lambda t: ~F.exists("base", lambda b: (b["start"] < t["span"]["end"]) & (t["span"]["start"] < b["end"])))
    return base.join(terms, same, "left").select("id", "digest", "base", F.coalesce(outside, none).alias("terms"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its texts sanitised: an entity becomes the name of its kind in brackets, a term is
    removed or becomes ``[word]`` or ``[number]``. Overlapping spans are replaced once, by the first."""
    base = F.transform("base", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("by")))
    kind = lambda t: F.when(t["span"]["value"].rlike(r"^\p{N}+$"), F.lit("[number]")).otherwise(F.lit("[word]"))
    terms = F.transform("terms", lambda t: F.struct(
        t["span"]["start"].alias("start"), t["span"]["end"].alias("end"),
        F.when(t["disclosed"] >= REMOVE, F.lit("")).otherwise(kind(t)).alias("by")))
    spans = (
        private_spans(docs, id_col, text_col).where("size(base) + size(terms) > 0").dropDuplicates(["id", "digest"])
        .select(F.col("id").alias("_span_id"), F.col("digest").alias("_span_digest"),
                F.array_sort(F.concat(base, terms)).alias("_spans"))
    )
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        out = F.when(fresh, F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), s["by"]))
        return F.struct(F.greatest(state["at"], s["end"]).cast("int").alias("at"), out.otherwise(state["out"]).alias("out"))

    replaced = F.aggregate("_spans", start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))
    rows = docs.withColumn("_text_digest", F.xxhash64(F.coalesce(text, F.lit(""))))
    same = F.col(id_col).eqNullSafe(F.col("_span_id")) & (F.col("_text_digest") == F.col("_span_digest"))
    joined = rows.join(spans, same, "left")
    return joined.select(*[
        F.when(F.col("_spans").isNull(), text).otherwise(replaced).alias(c) if c == text_col else F.col(f"`{c}`")
        for c in docs.columns
    ])
