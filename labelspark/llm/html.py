"""Main text of web pages by a tree-structured graphical model over the nodes of a page.

Every element and text of a page is a node that is content or not. Nodes score their own features
(tag, names in class, id and role, text and link volume), and a parent and a child score how well
their states go together. Sum-product messages, first from the leaves to the root and then back,
give each node's exact marginal probability of being content. Weights are fitted by gradient ascent
on the likelihood of labelled pages, whose expectations come from the same messages. The nodes of a
whole batch of pages are passed level by level in arrays.

Labelled pages are a bounded sample of pages that mark their article, and the texts of these pages
set into other layouts (sidebars, notices, adverts, forms and comments around and within the article).

Defined results: a null, empty or textless page has an empty text; unclosed and stray tags, cut-off
pages, and very long or deep ones are read as far as they go (a nest of any depth keeps its elements;
a level of the deepest page costs a pass over that level); repeated rows give repeated results; empty
tables give empty ones, and so does training: without labelled pages only layouts of a built-in sentence are learned from. Only the named columns
are read and returned.
"""

from __future__ import annotations

import html as references
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import seeded_share

# Labelled pages: all, or so many on average, each at most so long, those with the smallest seeded hashes.
SAMPLE_PAGES = 300
SAMPLE_CHARS = 40_000
SEED = 3
BATCH_PAGES = 256

# Fixed names of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template textarea select option button svg math iframe object canvas title head audio video datalist".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BLOCK = frozenset(
    "address article aside blockquote body br center caption dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("br caption td th tr tbody thead tfoot body html legend dt dd li".split()) | frozenset(["li", "dt", "dd"])
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
TAGS = {t: i + 2 for i, t in enumerate(sorted(BLOCK | VOID | HIDDEN | frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output progress q ruby s samp small span strike strong "
    "sub sup time tt u var".split())))}
INLINE = frozenset(TAGS) - BLOCK - HIDDEN

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']++|"[^"]*+"|'[^']*+')*+)(>?)""")
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_ARTICLE = re.compile(r"(<article\b[^>]*>).*</article>", re.S)
BUCKETS = 1_024
N_TAGS = len(TAGS) + 2
# Slots of a node's features, each an offset into the weights.
_PARENT, _LENGTH, _LINKS, _WORDS, _NAMED = N_TAGS, 2 * N_TAGS, 2 * N_TAGS + 16, 2 * N_TAGS + 24, 2 * N_TAGS + 32
N_FEATURES = _NAMED + BUCKETS
NO_FEATURE = N_FEATURES  # its weight stays zero
# Names of a node that have columns of their own; the others are (node, feature) pairs.
NAME_COLUMNS = 4


class Page:
    """Nodes of a page in page order: parents before children."""

    def __init__(self, text: str, labels: bool = False):
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.tag: list[int] = []
        self.names: list[tuple[int, ...]] = []
        self.texts: dict[int, str] = {}
        self.block: dict[int, int] = {}
        self.own_label: list[int] = []
        self._read(text, labels)
        self._merge()

    def _merge(self) -> None:
        """Elements of one tag and without names that hold nothing but one another become one node."""
        children = [0] * len(self.parent)
        for parent in self.parent[1:]:
            children[parent] += 1
        bare = [not names and label < 0 for names, label in zip(self.names, self.own_label, strict=True)]
        number, kept = [], []
        for node, parent in enumerate(self.parent):
            if parent > 0 and children[parent] == 1 and self.tag[node] == self.tag[parent] and bare[node] and bare[parent]:
                number.append(number[parent])
            else:
                number.append(len(kept))
                kept.append(node)
        if len(kept) == len(number):
            return
        self.parent = [-1 if self.parent[k] < 0 else number[self.parent[k]] for k in kept]
        self.tag, self.names, self.own_label = ([x[k] for k in kept] for x in (self.tag, self.names, self.own_label))
        self.depth = [0]
        for parent in self.parent[1:]:
            self.depth.append(self.depth[parent] + 1)
        self.texts = {number[k]: v for k, v in self.texts.items()}
        self.block = {number[k]: v for k, v in self.block.items()}

    def _node(self, parent: int, tag: int, names: tuple[int, ...], label: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(tag)
        self.names.append(names)
        self.own_label.append(label)
        return len(self.parent) - 1

    def _read(self, text: str, labels: bool) -> None:
        stack, tags = [self._node(-1, 0, (), -1)], [""]
        places: dict[str, list[int]] = {}  # of the open elements of each tag in the stack
        at, block, hidden, blank_in = 0, 0, 0, -1
        end = len(text)

        def words(a: int, b: int) -> None:
            nonlocal blank_in
            if hidden or a >= b:
                return
            found = text[a:b]
            if "&" in found:
                found = references.unescape(found)
            if found.isspace():  # between inline elements it keeps words apart
                blank_in = block
                return
            node = self._node(stack[-1], 1, (), -1)
            self.texts[node] = " " + found if blank_in == block else found
            self.block[node] = block
            blank_in = -1

        def close(depth: int) -> None:
            nonlocal block, hidden
            while len(stack) > depth:
                stack.pop()
                tag = tags.pop()
                places[tag].pop()
                if tag in BLOCK:
                    block += 1
                if tag in HIDDEN:
                    hidden -= 1

        while at < end:
            start = text.find("<", at)
            if start < 0:
                words(at, end)
                break
            if text.startswith("<!--", start):
                words(at, start)
                stop = text.find("-->", start + 4)
                at = end if stop < 0 else stop + 3
                continue
            found = _TAG.match(text, start)
            if found is None:
                if text[start + 1:start + 2] in ("!", "?"):
                    words(at, start)
                    stop = text.find(">", start)
                    at = end if stop < 0 else stop + 1
                else:  # a bare sign is text
                    stop = text.find("<", start + 1)
                    words(at, end if stop < 0 else stop)
                    at = end if stop < 0 else stop
                continue
            words(at, start)
            at = found.end()
            if not found[4]:  # a quote that is never closed: the tag ends at the next sign, or is cut off
                stop = text.find(">", at)
                at = end if stop < 0 else stop + 1
                if stop < 0:
                    break
            tag = found[2].lower()
            if found[1]:
                if tag == "br":
                    block += 1
                if places.get(tag):
                    close(places[tag][-1])
                continue
            if tag in CLOSES_P and places.get("p"):
                close(places["p"][-1])
            if tag in CLOSES:
                last, within = (max((places[t][-1] for t in some if places.get(t)), default=0) for some in CLOSES[tag])
                if last > within:
                    close(last)
            if tag in BLOCK:
                block += 1
            if tag in VOID:
                continue
            names, label = (), -1
            if found[3] and "=" in found[3]:
                names, label = self._names(found[3], labels)
            node = self._node(stack[-1], TAGS.get(tag, 0), names, label)
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
            tags.append(tag)
            hidden += tag in HIDDEN
            if tag in RAW:
                stop = _raw_end(text, tag, at)
                at = end if stop < 0 else stop

    def _names(self, attributes: str, labels: bool) -> tuple[tuple[int, ...], int]:
        found, label = [], -1
        for name, *values in _NAMES.findall(attributes):
            value = "".join(values)
            if name.lower() == "data-y":
                label = int(value) if labels and value in ("0", "1") else -1
            else:
                found += _WORD.findall(value.lower())
        return tuple(zlib.crc32(w.encode()) % BUCKETS for w in dict.fromkeys(found)), label

    def content(self, chosen: np.ndarray) -> str:
        """Text of the chosen nodes: blank runs of a block become one, blocks are joined by line ends."""
        blocks: list[list[str]] = []
        last = -1
        for node, found in self.texts.items():
            if chosen[node]:
                if self.block[node] != last:
                    blocks.append([])
                    last = self.block[node]
                blocks[-1].append(found)
        lines = (" ".join("".join(b).split()) for b in blocks)
        return "\n".join(line for line in lines if line)


def _raw_end(text: str, tag: str, at: int) -> int:
    """Where the end tag of an element of plain characters begins."""
    while True:
        stop = text.find("</", at)
        if stop < 0 or text[stop + 2:stop + 2 + len(tag)].lower() == tag:
            return stop
        at = stop + 2


@dataclass
class Forest:
    """The nodes of many pages in arrays, with the rows of every level."""

    parent: np.ndarray
    group: np.ndarray
    features: np.ndarray
    more: tuple[np.ndarray, np.ndarray]
    levels: list[np.ndarray]
    firsts: np.ndarray


def forest(pages: list[Page]) -> Forest:
    sizes = np.array([len(p.parent) for p in pages])
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    shift = np.repeat(firsts[:-1], sizes)
    parent = np.fromiter((x for p in pages for x in p.parent), np.int64, len(shift))
    parent = np.where(parent < 0, -1, parent + shift)
    depth = np.fromiter((x for p in pages for x in p.depth), np.int64, len(shift))
    tag = np.fromiter((x for p in pages for x in p.tag), np.int64, len(shift))
    size, count = np.zeros(len(shift)), np.zeros(len(shift))
    for page, first in zip(pages, firsts, strict=False):
        for node, found in page.texts.items():
            size[first + node] = len(found)
            count[first + node] = found.count(" ") + 1
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 1)))
    # Text within links, from the links down; text volumes, from the leaves up.
    linked = tag == TAGS["a"]
    for rows in levels[1:]:
        linked[rows] |= linked[parent[rows]]
    volume, in_links, words = size.copy(), size * linked, count.copy()
    for rows in levels[:0:-1]:
        for sums in (volume, in_links, words):
            np.add.at(sums, parent[rows], sums[rows])
    features = np.full((len(shift), 5 + NAME_COLUMNS), NO_FEATURE)
    features[:, 0] = tag
    features[:, 1] = _PARENT + np.where(parent < 0, 0, tag[parent])
    features[:, 2] = _LENGTH + np.minimum(np.log2(volume + 1).astype(int), 15)
    features[:, 3] = _LINKS + np.minimum((in_links / np.maximum(volume, 1) * 5).astype(int), 5) + 0
    features[:, 4] = _WORDS + np.minimum(np.log2(words + 1).astype(int), 7)
    named = [(first + node, names) for page, first in zip(pages, firsts, strict=False)
             for node, names in enumerate(page.names) if names]
    for row, names in named:
        first_names = names[:NAME_COLUMNS]
        features[row, 5:5 + len(first_names)] = [_NAMED + n for n in first_names]
    pairs = [(row, _NAMED + n) for row, names in named for n in names[NAME_COLUMNS:]]
    more = tuple(np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    # A pair's potential depends on the child: a text, an inline element, a block, one with names.
    kind = np.full(N_TAGS, 2)
    kind[1] = 0
    kind[[TAGS[t] for t in INLINE]] = 1
    group = kind[tag]
    group[np.array([row for row, _ in named], np.int64)] = 3
    return Forest(parent, group, features, more, levels, firsts)


N_GROUPS = 4


def messages(trees: Forest, weights: np.ndarray, pairs: np.ndarray):
    """Marginals of nodes being content, and of the states (parent, child) of every node with a parent."""
    n = len(trees.parent)
    up = np.zeros((n, 2))
    up[:, 1] = np.append(weights, 0.0)[trees.features].sum(axis=1) + np.bincount(trees.more[0], weights[trees.more[1]], n)
    sent = np.zeros((n, 2))
    for rows in trees.levels[:0:-1]:
        both = up[rows][:, None, :] + pairs[trees.group[rows]]
        sent[rows] = np.logaddexp(both[:, :, 0], both[:, :, 1])
        np.add.at(up, trees.parent[rows], sent[rows])
    belief = up.copy()
    together = np.zeros((n, 2, 2))
    for rows in trees.levels[1:]:
        rest = belief[trees.parent[rows]] - sent[rows]
        both = rest[:, :, None] + pairs[trees.group[rows]]
        joint = both + up[rows][:, None, :]
        belief[rows] += np.logaddexp(both[:, 0], both[:, 1])
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        together[rows] = joint / joint.sum(axis=(1, 2), keepdims=True)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), together


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    pairs: np.ndarray

    def extract(self, pages: list[str]) -> list[str]:
        read = [Page(p) for p in pages]
        trees = forest(read)
        content, _ = messages(trees, self.weights, self.pairs)
        return [p.content(content[a:b] >= 0.5) for p, a, b in zip(read, trees.firsts, trees.firsts[1:], strict=False)]


def fit(pages: list[tuple[Page, list[int]]], steps: int = 250, rate: float = 0.3, penalty: float = 0.005) -> Model:
    """Weights that make the labels of ``(page, label of every node)`` likely."""
    trees = forest([p for p, _ in pages])
    label = np.concatenate([np.array(y, float) for _, y in pages])
    inner = trees.parent >= 0
    states = np.zeros((len(label), 2, 2))
    rows = np.flatnonzero(inner)
    states[rows, label[trees.parent[rows]].astype(int), label[rows].astype(int)] = 1
    weights, pairs = np.zeros(N_FEATURES), np.zeros((N_GROUPS, 2, 2))
    node = np.append(np.repeat(np.arange(len(label)), trees.features.shape[1]), trees.more[0])
    feature = np.append(trees.features.ravel(), trees.more[1])
    seen = np.bincount(feature, minlength=N_FEATURES + 1)[:-1]
    square_w, square_p = np.full(N_FEATURES, 1e-8), np.full(pairs.shape, 1e-8)
    for _ in range(steps):
        content, together = messages(trees, weights, pairs)
        slope = np.bincount(feature, (label - content)[node], N_FEATURES + 1)[:-1] / np.maximum(seen, 20) - penalty * weights
        slope_p = np.stack([
            (states - together)[inner & (trees.group == g)].sum(axis=0) / max((trees.group == g).sum(), 1) for g in range(N_GROUPS)
        ]) - penalty * pairs / 10
        square_w += slope**2
        square_p += slope_p**2
        weights = weights + rate * slope / np.sqrt(square_w)
        pairs = pairs + rate * slope_p / np.sqrt(square_p)
    return Model(weights, pairs)


def labels_of(page: Page, article: int) -> list[int]:
    """Labels that descend: from an article's tag, from marks, and from tags that are never content."""
    never = {TAGS[t] for t in ("nav", "footer", "aside", "form", "header")}
    label: list[int] = []
    for node, parent in enumerate(page.parent):
        own = label[parent] if parent >= 0 else 0
        if page.own_label[node] >= 0:
            own = page.own_label[node]
        elif page.tag[node] == article:
            own = 1
        elif own and page.tag[node] in never:
            own = 0
        label.append(own)
    return label


# Names that layouts give to their parts, one list per part.
ARTICLE_NAMES = ["content", "main-content", "post", "entry-content", "article-body", "story", "post-body", "main", "text", "page-content"]
OTHER_PARTS = {
    "nav": (["nav", "div", "ul"], ["menu", "navigation", "navbar", "breadcrumb", "breadcrumbs", "topnav", "pagination", "toc"]),
    "header": (["header", "div"], ["header", "site-header", "masthead", "top", "branding"]),
    "footer": (["footer", "div"], ["footer", "site-footer", "bottom", "copyright", "legal"]),
    "aside": (["aside", "div", "section"], ["sidebar", "side", "widget", "related", "recommended", "more-stories", "tags", "author-box"]),
    "notice": (["div", "section", "p"], ["notice", "cookie", "cookie-banner", "consent", "alert", "warning", "popup", "gdpr", "privacy", "modal", "banner"]),
    "ad": (["div", "aside", "section", "p"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor", "banner-ad"]),
    "form": (["form", "div"], ["form", "newsletter", "signup", "subscribe", "search", "login", "contact-form", "subscription"]),
    "share": (["div", "ul"], ["share", "social", "social-links", "sharing"]),
    "comments": (["section", "div", "ol"], ["comments", "comment-list", "discussion", "responses", "reader-comments", "replies", "disqus"]),
}


def layout(paragraphs: list[str], others: list[str], draw: np.random.Generator) -> str:
    """A labelled page (``data-y``) with the paragraphs as its article and the other texts around and in it."""
    def pick(found):
        return found[int(draw.integers(len(found)))]

    def short():
        return references.escape(" ".join(pick(others).split()[:int(draw.integers(1, 9))]))

    def sentence():
        return references.escape(" ".join(pick(others + paragraphs).split()[:int(draw.integers(4, 40))]))

    def other(kind):
        tags, names = OTHER_PARTS[kind]
        tag, name = pick(tags), pick(names)
        mark = "" if tag in OTHER_PARTS and draw.random() < 0.5 else f' {pick(["class", "class", "id"])}="{name}"'
        if kind in ("nav", "share") or (kind in ("footer", "aside", "header") and draw.random() < 0.4):
            items = "".join(f'<li><a href="/{i}">{short()}</a></li>' for i in range(int(draw.integers(2, 8))))
            body = items if tag in ("ul", "ol") else f"<ul>{items}</ul>"
        elif kind == "form":
            body = f'<label>{short()}</label><input type="text"><p>{sentence()}</p><button>{short()}</button>'
        elif kind == "comments":
            item = "li" if tag == "ol" else pick(["div", "article", "p"])
            body = (f"<h3>{short()}</h3>" if tag != "ol" else "") + "".join(
                f'<{item} class="comment"><b>{short()}</b> <p>{sentence()}</p></{item}>' for _ in range(int(draw.integers(1, 5))))
        else:
            body = "".join(f"<p>{sentence()}</p>" if tag != "p" and draw.random() < 0.6 else f"{sentence()} " for _ in range(int(draw.integers(1, 4))))
        return f'<{tag}{mark} data-y="0">{body}</{tag}>'

    parts = []
    for i, p in enumerate(paragraphs):
        body = references.escape(p)
        if i == 0 and draw.random() < 0.7:
            parts.append(f"<h1>{body}</h1>")
        elif draw.random() < 0.08:
            parts.append(f"<ul><li>{body}</li></ul>")
        elif draw.random() < 0.08:
            parts.append(f"<blockquote><p>{body}</p></blockquote>")
        elif draw.random() < 0.08:
            parts.append(f"<h2>{body[:40]}</h2><p>{body}</p>")
        elif draw.random() < 0.15:
            cut = body.find(" ") + 1
            parts.append(f"<p>{body[:cut]}<em>{body[cut:cut + 20]}</em><a href='/x'>{body[cut + 20:cut + 40]}</a>{body[cut + 40:]}</p>")
        else:
            parts.append(f"<p>{body}</p>")
        if draw.random() < 0.08:
            parts.append(other(pick(["ad", "aside", "form", "notice", "share", "nav"])))
    if draw.random() < 0.25:
        parts.append(other("comments"))
    tag = pick(["article", "article", "article", "main", "div", "section"])
    name = f' {pick(["class", "id"])}="{pick(ARTICLE_NAMES)}"' if tag not in ("article", "main") or draw.random() < 0.4 else ""
    body = f'<{tag}{name} data-y="1">{"".join(parts)}</{tag}>'
    before = [other(k) for k in ("header", "nav", "notice", "ad") if draw.random() < 0.6]
    after = [other(k) for k in ("comments", "aside", "ad", "form", "share", "footer", "notice") if draw.random() < 0.5]
    inside = "".join([*before, body, *after])
    if draw.random() < 0.5:
        inside = f'<div class="{pick(["wrapper", "container", "page", "site", "layout"])}">{inside}</div>'
    return f"<html><head><title>{short()}</title></head><body>{inside}</body></html>"


def labelled(pages: list[str], seed: int = SEED) -> list[tuple[Page, list[int]]]:
    """Labelled pages from pages that mark their article, and three layouts of each page's texts."""
    draw = np.random.default_rng(seed)
    article, found, texts = TAGS["article"], [], []
    for text in pages:
        page = Page(text)
        label = labels_of(page, article)
        inside: dict[int, list[str]] = {}
        for node, words in page.texts.items():
            if label[node]:
                inside.setdefault(page.block[node], []).append(words)
        paragraphs = [" ".join("".join(b).split()) for b in inside.values()]
        outside = [" ".join(w.split()) for node, w in page.texts.items() if not label[node]]
        if paragraphs:
            found.append((page, label))
            texts.append((paragraphs[:30], outside))
            if len(texts) % 3 == 0:  # the same page around a short article
                words = [references.escape(" ".join(p.split()[:int(draw.integers(1, 4))])) for p in paragraphs[:int(draw.integers(1, 3))]]
                short = "".join(f"<p>{w}</p>" for w in words[1:])
                page = Page(_ARTICLE.sub(lambda m, w=words[0], s=short: f"{m[1]}<h1>{w}</h1>{s}</article>", text, count=1))
                found.append((page, labels_of(page, article)))
    sentence = "This is a plain sentence of some words, and it stands for any text of a page."
    others = [w for _, o in texts for w in o] or [sentence]
    for i, (paragraphs, _) in enumerate((texts or [([sentence] * 4, [])] * 50) * 3):
        if i % 3 == 2:  # short articles are articles too
            paragraphs = [" ".join(p.split()[:int(draw.integers(1, 12))]) for p in paragraphs[:int(draw.integers(1, 4))]]
        page = Page(layout(paragraphs, others, draw), labels=True)
        found.append((page, labels_of(page, -1)))
    return found


def train_extractor(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE_PAGES, longest: int = SAMPLE_CHARS, seed: int = SEED) -> Model:
    """A model fitted on some ``sample`` pages of at most ``longest`` characters that mark an article; a page
    that is repeated counts once."""
    column = F.col(html_col)
    marked = pages.select(column.alias("html")).where(F.contains(column, F.lit("<article")) & (F.char_length(column) <= longest))
    rows = (
        seeded_share(marked.select("html", F.xxhash64(F.lit(seed), "html").alias("draw")), "draw", sample)
        .groupBy("draw").agg(F.min("html").alias("html")).orderBy("draw").collect()
    )
    return fit(labelled([r.html for r in rows], seed))


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, BATCH_PAGES):
                batch = whole.slice(first, BATCH_PAGES)
                found = model.extract([t or "" for t in batch["html"].to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], batch["url"], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                    ["id", "url", "text", "n_chars"],
                )

    id_type = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {id_type}, url string, text string, n_chars bigint").withColumnsRenamed({"id": id_col, "url": url_col})
