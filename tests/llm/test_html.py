from __future__ import annotations

import itertools

import numpy as np
import pytest

from labelspark.llm import html


@pytest.fixture(scope="module")
def model(spark):
    return html.train_extractor(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_messages_are_exact_marginals():
    draw = np.random.default_rng(1)
    page = html.Page("<div>a<p class='x'>b<i>c</i></p><ul><li>d</ul></div>")
    trees = html.forest([page])
    weights, pairs = draw.normal(size=html.N_FEATURES), draw.normal(size=(html.N_GROUPS, 2, 2))
    content, together = html.messages(trees, weights, pairs)
    own = np.append(weights, 0)[trees.features].sum(axis=1)
    n = len(own)
    chance, both = np.zeros(n), np.zeros((n, 2, 2))
    for states in itertools.product((0, 1), repeat=n):
        y = np.array(states)
        score = (own * y).sum() + sum(pairs[trees.group[i], y[trees.parent[i]], y[i]] for i in range(1, n))
        chance += np.exp(score) * y
        for i in range(1, n):
            both[i, y[trees.parent[i]], y[i]] += np.exp(score)
    total = both[1].sum()
    assert np.allclose(content, chance / total)
    assert np.allclose(together[1:], both[1:] / total)


def test_held_out_pages(spark, model):
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id >= 1000").limit(300).collect()
    draw = np.random.default_rng(2)
    wrong = texts = 0
    for r in rows:
        page = html.Page(r.html)
        label = html.labels_of(page, html.TAGS["article"])
        assert model.extract([r.html])[0] == page.content(np.array(label, bool)) or len(page.content(np.array(label, bool))) < 60
        inside = [" ".join(t.split()) for n, t in page.texts.items() if label[n]][:10]
        outside = [t for n, t in page.texts.items() if not label[n]]
        if inside:  # a layout that the model hasn't seen
            other = html.Page(html.layout(inside, outside, draw), labels=True)
            truth = html.labels_of(other, -1)
            content, _ = html.messages(html.forest([other]), model.weights, model.pairs)
            wrong += sum((content[n] >= 0.5) != truth[n] for n in other.texts)
            texts += len(other.texts)
    assert wrong <= 0.02 * texts


def test_reading():
    every = lambda text: html.Page(text).content(np.ones(9_999, bool))
    assert every("<p>a &amp; b&nbsp;&eacute;\n c <b>d</b>e<p>f<br>g") == "a & b é c de\nf\ng"
    assert every("a<script>var t='</p>';<p>no</script><style>x{}</style><!-- <p>no --> b<title>no</title>") == "a b"
    assert every("1 < 2 <p title='a>b'>x</p><p class=\"never closed>y") == "1 < 2\nx\ny"
    assert every("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>") == "a\nb\nc\nd\ne"
    assert every("<b>a</b> <i>b</i>") == every("<b>a</b><span></span> <i>b</i>") == every("<b>a</b> <span> <i>b</i></span>") == "a b"
    assert every("a<textarea>no</TEXTAREA>b<title>no") == "ab"
    assert every("<p>cut <a href='x") == "cut"
    assert every("") == "" and every("<") == "<" and every("</p></div>") == ""
    assert every("<div>" * 5_000 + "deep" + "</div>" * 5_000) == "deep"


def test_odd_pages(spark, model):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>" + "word " * 200_000 + "</p></article>"), (3, "u", "<nav>menu</nav>"), (3, "u", "<nav>menu</nav>")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, text string, n_chars string")
    got = html.extract(df, model).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 0), ("2", 0), ("3", 0), ("3", 0), ("None", 999_999)]
    assert all(r.n_chars == len(r.text) for r in got)
    assert html.extract(df.limit(0), model).count() == 0
    assert html.train_extractor(df.limit(0)).extract(["<article><p>Some words that make a sentence.</p></article>"]) is not None


@pytest.mark.parametrize("deep", [250, 3_000])
def test_text_after_and_in_a_deep_nest(deep):
    page = html.Page("<body><div><article><p>A</p>" + "<div>" * deep + "<nav>menu</nav><button>no</button>deep" + "</div>" * deep + "<p>B</p></article></div>C")
    label = html.labels_of(page, html.TAGS["article"])
    assert page.content(np.ones(9_999, bool)) == "A\nmenu\ndeep\nB\nC"
    assert page.content(np.array(label, bool)) == "A\ndeep\nB"


@pytest.mark.parametrize("deep", [0, 100, 250, 3_000])
def test_extraction_below_a_deep_nest(model, deep):
    text = "".join(f"<p>Sentence {i} of an article that stands far below the root of its page.</p>" for i in range(8))
    nested = lambda opened, closed: f"<html><body><nav><a href='/'>menu</a></nav>{opened}<article>{opened}<h1>Title</h1>{text}{closed}</article>{closed}<footer><p>foot</p></footer></body></html>"
    flat = model.extract([nested("", "")])[0]
    assert flat.startswith("Title\nSentence 0") and flat.endswith("its page.") and flat.count("\n") == 8
    assert model.extract([nested("<div>" * deep, "</div>" * deep)])[0] == flat
    assert model.extract([nested("<div><section>" * deep, "</section></div>" * deep)])[0] == flat


def test_nests_are_one_node():
    page = html.Page("<div><div><div><p>a</p></div></div></div><div><div class='x'><div>b</div></div></div>")
    assert len(page.parent) == 8 and page.content(np.ones(9, bool)) == "a\nb"
    assert html.Page("<b>" * 50_000 + "x").depth == [0, 1, 2]


def test_all_names_count():
    page = html.Page("<div class='col-md-4 col-xs-12 widget-area sidebar' id='left'>a</div>")
    trees = html.forest([page])
    words = "col md xs widget area sidebar left".split()
    assert len(page.names[1]) == len(words)
    for word in words:
        weights, pairs = np.zeros(html.N_FEATURES), np.zeros((html.N_GROUPS, 2, 2))
        weights[html._NAMED + html.zlib.crc32(word.encode()) % html.BUCKETS] = 3.0
        content, _ = html.messages(trees, weights, pairs)
        assert np.allclose(content[1], 1 / (1 + np.exp(-3.0)))
    label = [0, 1, 1]
    model = html.fit([(page, label)], steps=5)
    assert all(model.weights[html._NAMED + html.zlib.crc32(w.encode()) % html.BUCKETS] > 0 for w in words)
