from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from labelspark.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


BRUTE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    found = []
    for rank, (kind, pattern) in enumerate(BRUTE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split("."))
                    or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits))
                    or kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            found.append((m.start(), rank, m.end()))
    return sorted(found)


def test_base_spans(spark):
    draw = random.Random(5)
    pieces = ["a@b.c", "x.y+z@mail-1.example.com", "@", "a@b", "1.2.3.4", "256.1.1.1", "001.002.003.004", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111",
              "4111111111111112", "0000-0000-0000", "+1 (234) 567-8901", "+12", "+4930123456 789", "\x01", "😀", "é", " ", "-", ".", "_", "7", "12", "%a@b.co_x@y.org"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 12))) for _ in range(2_000)]
    texts += [None, "", "9" * 20_000, "9 " * 8_000, "a" * 50_000 + "@", "1." * 20_000, "+" * 3_000, "a.b" * 10_000 + "@x.yz", "+1" + "(" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r.id: [(s.start, s.rank, s.end) for s in r.base] for r in pii.detect(df).select("id", "base").collect()}
    assert got == {i: brute(t or "") for i, t in enumerate(texts)}


def plants():
    """A name stands near one address in many surroundings, and nowhere else."""
    draw = random.Random(6)
    words = ["river", "stone", "cloud", "paper", "green", "table", "lamp", "road", "window", "garden", "music", "letter", "wrote", "from", "about"]
    some = lambda n: " ".join(draw.choice(words) for _ in range(n))
    docs = [(i, f"{some(30)} Zebulon wrote from zeb@example.org about {some(20)}") for i in range(6)]
    docs += [(20, f"Zebulon again, {some(10)}; his address is zeb@example.org and zebulons differ")]
    docs += [(100 + i, some(60)) for i in range(300)]
    copy = "quixotic harbinger near copy@example.org mentions obfuscation"
    docs += [(500 + i, copy) for i in range(10)]
    return docs


def test_disclosing_terms(spark):
    docs = plants()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    rows = {r.id: r for r in pii.private_spans(df).collect()}
    for i, text in docs:
        terms = [text[t.span.start:t.span.end].lower() for t in rows[i].terms]
        if i <= 20:
            assert terms and set(terms) == {"zebulon"}
            assert all(t.disclosed >= pii.REMOVE for t in rows[i].terms)
        else:
            assert terms == []  # other words, and ten copies of one text
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "zeb" not in clean[20].replace("zebulons", "").lower() and "[EMAIL]" in clean[20] and "zebulons" in clean[20]
    assert all(clean[i] == t for i, t in docs if 100 <= i < 500)
    assert clean[500] == "quixotic harbinger near [EMAIL] mentions obfuscation"


def test_sanitise_by_spans(spark):
    texts = ["call +1 (234) 567-8901 now", "x 1.2.3.4 y 4111 1111 1111 1111.", "none", None, "", "é😀 a@b.cd é😀"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert got == {0: "call [PHONE] now", 1: "x [IP] y [CARD].", 2: "none", 3: None, 4: "", 5: "é😀 [EMAIL] é😀"}


def test_odd_tables(odd, none):
    got = pii.sanitise(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    assert pii.private_spans(odd).count() == odd.count()
    assert pii.private_spans(none).count() == 0 and pii.sanitise(none).count() == 0


def test_only_built_in_functions(odd):
    plan = pii.private_spans(odd).select(pii.span_text(F.col("base")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_terms_of_whole_documents(spark):
    """A name in the heading discloses a rare value far below; words of near-copies disclose nothing."""
    draw = random.Random(7)
    words = ["".join(draw.choice("abcdefgh") for _ in range(3)) + "x" for _ in range(150)]
    some = lambda n: " ".join(draw.choice(words) for _ in range(n))
    docs = [(i, f"Zebulon: {some(80)} +49 30 1234567{i // 2} {some(20)}; +49 30 1234567{i // 2}") for i in (0, 1)]
    copy = some(120).split()
    docs += [(10 + i, " ".join(["Quixotic", *copy[:40], f"edit{i}", *copy[40:], "copy@example.org"])) for i in range(5)]
    docs += [(100 + i, some(100)) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    rows = {r.id: [t.span.value.lower() for t in r.terms] for r in pii.private_spans(df).collect()}
    assert {i: set(t) for i, t in rows.items() if t} == {0: {"zebulon"}, 1: {"zebulon"}}


def test_terms_where_the_entity_is_not_named(spark):
    draw = random.Random(10)
    words = ["".join(draw.choice("abcdefgh") for _ in range(3)) + "x" for _ in range(150)]
    some = lambda n: " ".join(draw.choice(words) for _ in range(n))
    docs = [(i, f"Zebulon {some(60)} zeb@example.org {some(20)}") for i in range(20)]
    docs += [(50, f"{some(30)} ZEBULON {some(30)}")]
    docs += [(100 + i, some(80)) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    rows = {r.id: [t.span.value.lower() for t in r.terms] for r in pii.private_spans(df).collect()}
    assert {i for i, t in rows.items() if t == ["zebulon"]} == {*range(20), 50}
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "zebulon" not in clean[50].lower() and clean[100] == docs[21][1]


def test_short_and_marked_names(spark):
    draw = random.Random(12)
    words = ["".join(draw.choice("abcdefgh") for _ in range(3)) + "x" for _ in range(150)]
    some = lambda n: " ".join(draw.choice(words) for _ in range(n))
    names = ["Ng", "王伟", "मीनाक्षी"]
    docs = [(20 * k + i, f"{some(40)} {name} {some(30)} person{k}@example.org") for k, name in enumerate(names) for i in range(12)]
    docs += [(100 + i, some(80)) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    rows = {r.id: [t.span.value for t in r.terms] for r in pii.private_spans(df).collect()}
    assert {i: t for i, t in rows.items() if t} == {20 * k + i: [name] for k, name in enumerate(names) for i in range(12)}
