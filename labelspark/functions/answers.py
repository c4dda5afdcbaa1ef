"""From a model's free-text or JSON answer to class ids.

A vocabulary is a list of class names, or a table of them, whose last entry stands for "unknown". One
answer is resolved by the first rule that decides it: exact name, class number, cut-off name, last name
mentioned, unknown.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.functions.mentions import candidates, name_filter
from labelspark.functions.text import squash, strip
from labelspark.session import as_list, checkpointed, settle

UNKNOWN = "Unknown"
# Above this many classes answers meet the classes by joins instead of literal arrays and one
# regular expression inside the plan. The results are the same.
EXPRESSION_CLASSES = 1_000

_SEPARATOR = "\x00"
_JSON_OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "true"}


def with_unknown(vocab: dict[str, list[str]]) -> dict[str, list[str]]:
    """A copy of the vocabulary with the unknown class appended to every label."""
    return {label: [*names, UNKNOWN] for label, names in vocab.items()}


def _clean(answer: Column) -> Column:
    return strip(F.lower(answer))


def _id_at(position: Column, n: int) -> Column:
    """Class id of a 1-based position; none for position 0."""
    return F.get(F.lit([None, *range(n)]).cast("array<int>"), position.cast("int"))


def match_exact(answer: Column, names: list[str]) -> Column:
    """Id of the class whose name is the whole answer."""
    return _id_at(F.array_position(F.lit(names), answer), len(names))


def match_number(answer: Column, names: list[str], strict: bool = True) -> Column:
    """Id written in digits; unknown when out of range, null when not a number.

    The strict bound also rejects the last real class, as the established result files do.
    """
    return _number(_clean(answer), len(names), strict)


def _number(text: Column, classes: int, strict: bool) -> Column:
    limit = classes - (2 if strict else 1)
    number = text.try_cast("int")
    decided = F.when(number < limit, number).otherwise(F.lit(classes - 1))
    return F.when(text.rlike(r"^[0-9]+$"), decided)


def match_prefix(answer: Column, names: list[str]) -> Column:
    """First class whose name starts with the answer, ignoring case and blanks.

    All names are searched at once: they are joined by a separator, and the place where
    "separator + answer" occurs first tells the class.
    """
    return _prefix(_clean(answer), names)


def _prefix(text: Column, names: list[str]) -> Column:
    squashed = [n.lower().strip().replace(" ", "") for n in names]
    starts, at = [], 1
    for name in squashed:
        starts.append(at)
        at += len(name) + 1
    haystack = _SEPARATOR + _SEPARATOR.join(squashed) + _SEPARATOR
    head = F.concat(F.lit(_SEPARATOR), F.replace(text, F.lit(" "), F.lit("")))
    place = F.position(head, F.lit(haystack))
    found = _id_at(F.array_position(F.lit(starts), place), len(names))
    return F.when(~F.contains(text, F.lit(_SEPARATOR)), found)


def mention_pattern(names: list[str]) -> str:
    """Alternation of the literal names in vocabulary order, blanks optional."""
    return "|".join(re.escape(n).replace("\\ ", " *") for n in names)


def match_last_mention(answer: Column, names: list[str]) -> Column:
    """Id of the last class name that occurs in the answer."""
    return _last_mention(_clean(answer), names)


def _last_mention(text: Column, names: list[str]) -> Column:
    mentions = F.regexp_extract_all(text, F.lit("(?iu)" + mention_pattern(names)), F.lit(0))
    last = squash(F.try_element_at(mentions, F.lit(-1)))
    return _id_at(F.array_position(F.lit([n.lower().replace(" ", "") for n in names]), last), len(names))


def _class_forms(classes: DataFrame) -> DataFrame:
    """Class rows ``(id, name)`` in the forms that the rules compare, written once.

    ``start`` is what a cut-off answer begins with, ``plain`` a mentioned name, both without blanks;
    ``pattern`` is a mention with its blanks, which may be left out.
    """
    lower = F.lower("name")
    literal = F.regexp_replace(lower, r"([^\p{L}\p{N} ])", r"\\$1")
    pattern = F.concat(F.lit("^(?:"), F.replace(literal, F.lit(" "), F.lit(" *")), F.lit(r")\z"))
    start = F.replace(strip(lower), F.lit(" "), F.lit(""))
    return checkpointed(classes.select("id", "name", start.alias("start"), squash(F.col("name")).alias("plain"), pattern.alias("pattern")))


def _first_id(classes: DataFrame, form: str, into: str) -> DataFrame:
    return classes.groupBy(F.col(form).alias(f"_{into}_key")).agg(F.min("id").alias(into))


def _last_mentions(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """``(tid, _mentioned)``: for cleaned ``texts (tid, text)`` the last class name that a scan from the left meets.

    Texts are scanned where they lie, through a filter of all names; what passes it meets the names by equal strings
    without blanks, and blanks are confirmed by the name's pattern. At a place the first name in order counts, and a
    place within a name met before is passed over. Texts without a name have no row.
    """
    names = classes.where("plain <> ''").select("id", "pattern", F.col("plain").alias("key"))
    plain = _first_id(names, "key", "plain").withColumnRenamed("_plain_key", "key")
    found = name_filter(plain)
    if found is None:
        return texts.select("tid", F.lit(None).cast("int").alias("_mentioned")).limit(0)
    named = settle(names.join(plain, "key"))
    met = candidates(texts, found).join(named.side(), "key").where(
        F.col("segment").isNull() | F.regexp_like("segment", F.col("pattern")))
    hits = met.select(F.inline("places"), "id", F.char_length("key").alias("size"), "plain")
    start = F.struct(F.lit(0).alias("end"), F.lit(None).cast("int").alias("last"))

    def step(state: Column, hit: Column) -> Column:
        free = hit["at"] >= state["end"]
        end = F.when(free, hit["at"] + hit["size"]).otherwise(state["end"])
        return F.struct(end.alias("end"), F.when(free, hit["plain"]).otherwise(state["last"]).alias("last"))

    scanned = hits.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("at", "id", "size", "plain"))).alias("hits"))
    return scanned.select("tid", F.aggregate("hits", start, step, lambda state: state["last"]).alias("_mentioned"))


def _with_joined_id(df: DataFrame, answer: str, classes: DataFrame, count: int, strict: bool, blank_is_first: bool, nested: bool, into: str) -> DataFrame:
    """Add the class id of ``answer`` for a table of ``count`` classes: the same rules as joins.

    Each different answer is resolved once. Exact names and cut-off names are looked up by value, the
    latter among all beginnings of the names; only answers that no earlier rule decides are searched
    for mentions.
    """
    classes = _class_forms(classes)
    given = df.select(F.col(answer).alias("answer")).distinct().withColumn("text", _clean(F.col("answer")))
    exact = _first_id(classes, "name", "exact")
    beginnings = classes.select("id", F.explode(F.transform(
        F.sequence(F.lit(0), F.char_length("start")), lambda n: F.left(F.col("start"), n))).alias("start"))
    begun = _first_id(beginnings, "start", "begun")
    head = F.replace("text", F.lit(" "), F.lit(""))
    rows = (
        given.withColumns({"number": _number(F.col("text"), count, strict), "head": F.when(~F.contains(F.col("text"), F.lit(_SEPARATOR)), head)})
        .join(exact, F.col("answer") == F.col("_exact_key"), "left").join(begun, F.col("head") == F.col("_begun_key"), "left")
    )
    tid = F.monotonically_increasing_id().alias("tid")
    early = checkpointed(rows.select(tid, "answer", "text", "exact", F.coalesce("number", "begun").alias("early")))
    mentions = _last_mentions(early.where("exact is null and early is null and text <> ''"), classes)
    unknown = F.lit(count - 1)
    later = F.coalesce("early", "_mentioned")
    if not blank_is_first:
        later = F.when(F.col("text") != "", later)
    counts = F.col("answer").isNotNull() if nested and blank_is_first else F.col("answer") != ""
    resolved = early.join(mentions, "tid", "left").select(
        F.col("answer").alias("_answer"), F.when(counts, F.coalesce("exact", later, unknown)).otherwise(unknown).alias(into))
    return df.join(resolved, F.col(answer).eqNullSafe(F.col("_answer")), "left").drop("_answer")


def last_mentions(df: DataFrame, text: str, vocab: DataFrame, label: str, into: str) -> DataFrame:
    """Add the id of the last class of ``label`` that a text names, null where it names none.

    ``vocab (label_name, class_id, class_name)`` stays a table. Texts may be whole documents; rows are written
    once and numbered, and texts are searched where they lie.
    """
    classes = _class_forms(_classes_of(vocab, label))
    rows = checkpointed(df.withColumn("_tid", F.monotonically_increasing_id()))
    texts = rows.select(F.col("_tid").alias("tid"), _clean(F.col(f"`{text}`")).alias("text")).where("text <> ''")
    found = _last_mentions(texts, classes).withColumnRenamed("tid", "_tid")
    joined = rows.join(found, "_tid", "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != into], F.col("_mentioned").alias(into))


def _classes_of(vocab: DataFrame, label: str) -> DataFrame:
    own = vocab.where(F.col("label_name") == label)
    return own.select(F.col("class_id").cast("int").alias("id"), F.col("class_name").alias("name"))


def parse_answer(
    answer: Column,
    names: list[str],
    strict_numeric: bool = True,
    blank_is_first: bool = False,
) -> Column:
    """Class id of one answer; ``names`` ends with the unknown class.

    An answer of blanks is unknown; ``blank_is_first`` gives it class 0 instead. The names are
    literals of the plan; for large vocabularies use :func:`with_class_ids`, which joins.
    """
    return _resolve(answer, _clean(answer), names, strict_numeric, blank_is_first)


def _resolve(answer: Column, text: Column, names: list[str], strict: bool, blank_is_first: bool,
             nested: bool = False) -> Column:
    """The rules in order. An empty answer is always unknown, an empty field only as a blank one is."""
    unknown = F.lit(len(names) - 1)
    later = F.coalesce(_number(text, len(names), strict), _prefix(text, names), _last_mention(text, names))
    if not blank_is_first:
        later = F.when(text != "", later)
    given = answer.isNotNull() if nested and blank_is_first else answer != ""
    return F.when(given, F.coalesce(match_exact(answer, names), later, unknown)).otherwise(unknown)


def json_fields(answer: Column) -> Column:
    """The first brace-to-brace object of the answer as ``map<string,string>``, null if invalid."""
    return F.from_json(F.regexp_extract(answer, r"\{[^}]*\}", 0), "map<string,string>", _JSON_OPTIONS)


def _label_value(label: str, position: int, n_labels: int) -> Column:
    """The answer given for one label, null when there is none.

    The last of repeated fields counts. When the object has as many fields as there are labels,
    a misnamed field is found by its position. A JSON null reads as the text ``None``.
    """
    fields = F.col("_names")
    key = F.when(F.array_contains(fields, label), F.lit(label)).when(
        F.size(fields) == n_labels, F.get(fields, F.lit(position))
    )
    place = F.array_position(F.col("_keys"), key).cast("int") - 1
    return F.when(key.isNotNull(), F.coalesce(F.get(F.col("_values"), place), F.lit("None")))


def with_class_ids(
    df: DataFrame,
    answer: str,
    vocab: dict[str, list[str]] | DataFrame,
    into: str,
    strict_numeric: bool = True,
    blank_is_first: bool = False,
    labels=None,
) -> DataFrame:
    """Add ``into``: a struct with one class id per label.

    With one label the answer is free text; with several it is read as a JSON object. ``vocab`` gives the
    names of each label in order, or is a table ``(label_name, class_id, class_name)`` of any size with the
    unknown class last, for which ``labels`` states the order of labels. A table is joined, and so are lists of
    more than ``EXPRESSION_CLASSES`` classes; that takes answers that are no stream.
    """
    lists = {} if isinstance(vocab, DataFrame) else vocab
    labels = as_list(labels) if isinstance(vocab, DataFrame) else list(vocab)
    rules = (strict_numeric, blank_is_first, len(labels) > 1)
    if len(labels) == 1:
        values = {labels[0]: F.col(f"`{answer}`")}
        staged = df
    else:
        fields = F.col("_fields")
        staged = df.withColumn("_fields", json_fields(F.col(f"`{answer}`"))).withColumns({
            "_names": F.array_distinct(F.map_keys(fields)),
            "_keys": F.reverse(F.map_keys(fields)),
            "_values": F.reverse(F.map_values(fields)),
        })
        values = {c: _label_value(c, i, len(labels)) for i, c in enumerate(labels)}
    staged = staged.withColumns({f"_a{i}": v for i, v in enumerate(values.values())})
    staged = staged.withColumns({f"_t{i}": _clean(F.col(f"_a{i}")) for i in range(len(labels))})
    small = {i: lists[c] for i, c in enumerate(labels) if len(lists.get(c, ())) <= EXPRESSION_CLASSES and c in lists}
    if isinstance(vocab, DataFrame):
        sizes = vocab.where(F.col("label_name").isin(labels)).groupBy("label_name").agg(F.max("class_id").alias("last"))
        sizes = {r.label_name: r.last + 1 for r in sizes.collect()}
    for i, label in enumerate(labels):
        if i in small:
            continue
        if lists:
            classes, count = _listed(df, lists[label]), len(lists[label])
        else:
            if label not in sizes:
                raise ValueError(f"the vocabulary has no classes of {label}")
            classes, count = _classes_of(vocab, label), sizes[label]
        staged = _with_joined_id(staged, f"_a{i}", classes, count, *rules, into=f"_i{i}")
    if small:
        # One row in, one row out: the generator keeps the optimizer from copying the parser
        # into every expression and filter that uses an id.
        ids = F.struct(*[
            _resolve(F.col(f"_a{i}"), F.col(f"_t{i}"), names, *rules).alias(f"_i{i}")
            for i, names in small.items()
        ])
        staged = staged.select("*", F.inline(F.array(ids)))
    result = F.struct(*[F.col(f"_i{i}").alias(label) for i, label in enumerate(labels)])
    return staged.select(*[F.col(f"`{c}`") for c in df.columns if c != into], result.alias(into))


def _listed(df: DataFrame, names: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(enumerate(names)), "id int, name string")
