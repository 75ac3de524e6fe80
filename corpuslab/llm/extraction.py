"""Main-text extraction by a tree-structured graphical model of the page.

A page becomes a tree of blocks: block elements (and inline ones that say what they are for)
with their runs of text as leaves. Every node is content or not. Its own evidence, tag, words of
class and id, length, links and punctuation, gives unary potentials; parent and child are
tied by pairwise potentials, so that what lies in a menu falls with the menu and what lies
in an article stands with it. Sum-product messages, up the tree and down again, give
the exact marginal of each node; runs of text with a marginal of one half or more are
the text of the page, in page order.

Weights are trained by gradient ascent on labelled pages, at most ``PAGES`` of them (those first by a
hash of the page id). Labels come from the pages whose own markup names the article (an
``article`` or ``main`` element): text in it is content unless an element inside it is named as something
else. While training, half of the pages hide these names from the features, so that other evidence
is learned too. The weights start from, and are pulled towards, fixed prior values, which are
all there is if no page is labelled.

A null or empty page, and one without content, gives an empty text. Repeated rows are read
alike; an empty table gives no rows. Pages are read whole; white space includes no-break spaces.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.common import table
from corpuslab.llm.tokens import slices

PAGES, ROUNDS, RATE, PULL = 300, 30, 0.5, 0.02
OPENING = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*+))")
ATTRIBUTES = re.compile(r"(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+(?=>)")
MARKS = re.compile("[\"'>]")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# fixed values: element names by what they do to the tree
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style noscript template textarea title iframe svg head object".split())
RAW = frozenset("script style textarea title iframe".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header html li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul button select option label legend".split())
CLOSES = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"),
}
# what may stand in a head; the start of anything else ends it
IN_HEAD = frozenset("base link meta title style script noscript template bgsound basefont noframes".split())
# silent elements that the start of a block ends if they have no end tag
UNENDED = frozenset("noscript svg object".split())
SCOPES = frozenset("table ul ol dl td th div article section select body html".split())
ENDS_PARAGRAPH = BLOCKS - frozenset("html body button select option label legend".split())
# prior weights of the content class: of tags, of words of class, id and role, of texts
TAG_PRIOR = {
    "nav": -4, "menu": -4, "footer": -4, "aside": -4, "form": -4, "header": -2, "button": -4,
    "select": -4, "option": -4, "label": -3, "legend": -3, "fieldset": -3, "dialog": -4,
    "article": 3, "main": 2, "p": 0.5, "h1": 1, "h2": 0.5, "h3": 0.3, "blockquote": 0.5, "pre": 0.5,
}
NAME_PRIOR = {
    word: weight
    for weight, group in (
        (-5, "comment comments reply replies disqus respond discussion"),
        (-5, "ad ads adv advert advertisement advertising adslot adsbox banner sponsor sponsored "
             "promo promotion promoted"),
        (-5, "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip toolbar"),
        (-5, "footer foot copyright legal colophon disclaimer"),
        (-5, "sidebar aside rail widget complementary"),
        (-5, "cookie cookies consent gdpr notice notification popup modal overlay alert warning "
             "paywall"),
        (-4, "share sharing social related recommended recommendations more newsletter subscribe "
             "subscription signup login search form tags trending popular"),
        (-3, "header head masthead topbar banner contentinfo byline meta author"),
        (-6, "hidden invisible none"),
        (2, "article articlebody content post entry story maintext text main body"),
    )
    for word in group.split()
}
TEXT_PRIOR = {
    "few": -0.5, "some": 0.0, "many": 1.5, "sentence": 0.7, "linked": -3.0, "rights": -1.0,
    "text": 0.0, "node": 0.0, "within": -8.0,  # within an element named as something else
}
LABELLED = ("tag:article", "tag:main", "name:articlebody")
FEATURES = {
    name: i for i, name in enumerate([
        *[f"tag:{t}" for t in sorted(BLOCKS | {"inline"})], *[f"name:{n}" for n in sorted(NAME_PRIOR)],
        *[f"under:{t}" for t in sorted(BLOCKS | {"inline"})], *TEXT_PRIOR])}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Model:
    unary: np.ndarray  # weight of each feature for the content class
    pairs: np.ndarray  # [parent label, child label]


def prior() -> Model:
    unary = np.zeros(len(FEATURES))
    for names, kind in ((TAG_PRIOR, "tag:"), (NAME_PRIOR, "name:"), (TEXT_PRIOR, "")):
        for name, weight in names.items():
            unary[FEATURES[kind + name]] = weight
    return Model(unary, np.array([[0.2, -5.0], [0.0, 0.8]]))


@dataclass
class Tag:
    start: int
    end: int
    name: str = ""  # none: a comment or declaration
    closes: bool = False
    attributes: str = ""
    text: str = ""  # of a CDATA section


class Tags:
    """The tags of a page in order, found in time linear in its length.

    A search for an end that is not there is never repeated from a later start: what no ``>`` or
    ``]]>`` follows once is known to have none, and the ends of tags with quotes are told for all
    places at once when the first tag without an end is met.
    """

    def __init__(self, source: str) -> None:
        self.source = source
        self.sections = self.declarations = True  # whether an end may still follow
        self.ends: dict[int, int] | None = None  # mark outside of quotes -> end of the tag, or -1
        self.places: list[int] = []

    def next(self, at: int) -> Tag | None:
        """The first tag that starts at a place or after it; a ``<`` without an end is text."""
        for found in OPENING.finditer(self.source, at):
            tag = self._comment(found) if not found[5] else self._element(found)
            if tag:
                return tag
        return None

    def _comment(self, found: re.Match) -> Tag | None:
        start, stop = found.start(), found.end()
        if found[1]:
            end = self.source.find("-->", stop)
            return Tag(start, len(self.source) if end < 0 else end + 3)
        if found[2] and self.sections:
            end = self.source.find("]]>", stop)
            if end >= 0:
                return Tag(start, end + 3, text=self.source[stop:end])
            self.sections = False
        end = self.source.find(">", stop) if self.declarations else -1
        self.declarations = end >= 0
        return Tag(start, end + 1) if end >= 0 else None

    def _element(self, found: re.Match) -> Tag | None:
        stop = found.end()
        if self.ends is None:
            inner = ATTRIBUTES.match(self.source, stop)
            if inner is None:
                self._find_ends(stop)
            end = inner.end() if inner else -1
        else:
            nth = bisect_left(self.places, stop)
            end = self.ends[self.places[nth]] if nth < len(self.places) else -1
        if end < 0:
            return None
        return Tag(found.start(), end + 1, found[5].lower(), bool(found[4]), self.source[stop:end])

    def _find_ends(self, at: int) -> None:
        self.places = [m.start() for m in MARKS.finditer(self.source, at)]
        self.ends = {}
        after = {'"': -1, "'": -1}  # the next mark of each kind
        following = dict.fromkeys(self.places, -1)  # the mark after each
        for left, right in zip(self.places, self.places[1:]):
            following[left] = right
        for place in reversed(self.places):
            mark = self.source[place]
            if mark == ">":
                self.ends[place] = place
            else:
                partner = after[mark]
                self.ends[place] = self.ends.get(following[partner], -1) if partner >= 0 else -1
                after[mark] = place


class Page:
    """The block tree of one page: parents come before children."""

    def __init__(self, source: str) -> None:
        self.parents, self.features, self.tags = [-1], [[FEATURES["node"]]], ["html"]
        self.runs: dict[int, str] = {}  # leaf -> text
        self.other = [False]  # whether a node or one around it is named as something else
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = []  # open elements and their nodes (inline: the node around)
        places: dict[str, list[int]] = {}  # depths of the open elements of each name
        scopes: list[int] = []  # depths of the open elements that end tags are not implied across
        silents: list[int] = []  # and of those without text of their own (a noscript may have some)
        unended: list[int] = []  # and of those silent ones that lack an end tag
        parts: list[str] = []
        node, links, linked, silent, at = 0, 0, 0, 0, 0
        ended: dict[str, set[int]] = {}

        def flush() -> None:
            nonlocal linked
            text = " ".join("".join(parts).split())
            if text:
                self._leaf(node, text, linked)
            parts.clear()
            linked = 0

        def close(depth: int) -> None:
            nonlocal node, links, silent
            while len(stack) > depth:
                name, around = stack.pop()
                for depths in (places[name], scopes, silents, unended):
                    if depths and depths[-1] == len(stack):
                        depths.pop()
                links -= name == "a"
                silent -= name in SILENT
                if around != node:
                    flush()
                    node = around

        def speak(name: str) -> None:
            """End an open head before what cannot stand in it, and unended silent elements before blocks."""
            heads = places.get("head")
            ends = [heads[-1]] if heads and name not in IN_HEAD and silents[-1] == heads[-1] else []
            if unended and name in BLOCKS:
                ends.append(unended[0])
            if ends and not (places.get("template") and places["template"][0] < min(ends)):
                close(min(ends))

        def imply(name: str) -> None:
            """End the elements that the start of another one ends."""
            names = CLOSES.get(name, ()) + (("p",) if name in ENDS_PARAGRAPH else ())
            while names:
                depth = max((places[n][-1] for n in names if places.get(n)), default=-1)
                if depth < 0 or scopes and depth < scopes[-1]:
                    return
                last = stack[depth][0]
                close(depth)
                if last == name:
                    return

        size, tags = len(source), Tags(source)
        while at < size:
            tag = tags.next(at)
            stop = tag.start if tag else size
            if stack and stack[-1][0] == "head" and source[at:stop].strip():
                close(len(stack) - 1)  # nor can text stand in it
            if stop > at and not silent:
                text = html.unescape(source[at:stop])
                parts.append(text)
                if links:
                    linked += len(text.strip())
            if not tag:
                break
            at, name = tag.end, tag.name
            if not name:
                if tag.text and not silent:
                    parts.append(tag.text)
                continue
            if tag.closes:
                if places.get(name):
                    close(places[name][-1])
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    flush()
                continue
            if silent:
                speak(name)
            imply(name)
            block, names = name in BLOCKS, self._names(tag.attributes)
            places.setdefault(name, []).append(len(stack))
            if name in SCOPES:
                scopes.append(len(stack))
            if name in SILENT and name != "noscript":
                silents.append(len(stack))
            if name in UNENDED:
                if name not in ended:
                    ended[name] = self._ended(name, source)
                if tag.start not in ended[name]:
                    unended.append(len(stack))
            stack.append((name, node))
            links += name == "a"
            silent += name in SILENT
            if block or names:
                flush()
                node = self._node(node, name if block else "inline", names)
            if name in RAW:
                end = re.compile(rf"</{name}\b", re.I).search(source, at)
                at = end.start() if end else size
            elif tag.attributes.rstrip().endswith("/") and not block:
                close(len(stack) - 1)
        close(0)
        flush()

    @staticmethod
    def _ended(name: str, source: str) -> set[int]:
        """The places where elements of a name start that have an end tag of their own."""
        out: set[int] = set()
        waiting: list[int] = []
        opening, at = re.compile(rf"<(/?){name}\b", re.I), 0
        while tag := opening.search(source, at):
            stop = source.find(">", tag.end())
            if stop < 0:
                break
            at = stop + 1
            if not tag[1] and source[stop - 1] != "/":
                waiting.append(tag.start())
            elif tag[1] and waiting:
                out.add(waiting.pop())
        return out

    @staticmethod
    def _names(attributes: str) -> list[int]:
        """Features of the words of class, id and role, and of being hidden."""
        if "=" not in attributes and "hidden" not in attributes:
            return []
        out = set()
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id", "role", "itemprop", "aria-label"):
                words = [w.lower() for w in NAMES.findall(value)]
                whole = re.split(r"[^a-z0-9]+", value.lower())
                out.update(FEATURES[f"name:{w}"] for w in [*words, *whole] if w in NAME_PRIOR)
            elif (key == "hidden" or (key == "aria-hidden" and value == "true")
                  or (key == "style" and HIDDEN.search(value.lower()))):
                out.add(FEATURES["name:hidden"])
        return sorted(out)

    def _node(self, parent: int, tag: str, names: list[int]) -> int:
        self.parents.append(parent)
        self.tags.append(tag)
        own = [FEATURES["node"], FEATURES[f"tag:{tag}"], *names]
        named = bool(sum(PRIOR.unary[f] for f in own) <= -3)
        self.features.append(own + [FEATURES["within"]] * self.other[parent])
        self.other.append(self.other[parent] or named)
        return len(self.parents) - 1

    def _leaf(self, parent: int, text: str, linked: int) -> None:
        words = text.count(" ") + 1
        features = [FEATURES["text"], FEATURES[f"under:{self.tags[parent]}"],
                    FEATURES["few" if words < 4 else "some" if words < 15 else "many"]]
        if text[-1] in ".!?…»”\"" and words > 3:
            features.append(FEATURES["sentence"])
        if 2 * linked > len(text):
            features.append(FEATURES["linked"])
        if "©" in text or "all rights reserved" in text.lower():
            features.append(FEATURES["rights"])
        if self.other[parent]:
            features.append(FEATURES["within"])
        self.other.append(False)
        self.parents.append(parent)
        self.tags.append("")
        self.features.append(features)
        self.runs[len(self.parents) - 1] = text

    def labels(self) -> np.ndarray | None:
        """Content by the page's own markup, or None where it names no article."""
        inside = np.zeros(len(self.parents), bool)
        marks = {FEATURES[x] for x in LABELLED}
        named = False
        for i, parent in enumerate(self.parents):
            own = set(self.features[i])
            if own & marks:
                named, inside[i] = True, True
            elif parent >= 0:
                inside[i] = inside[parent] and not self.other[i]
        if not named:
            return None
        out = np.zeros(len(self.parents), np.int64)
        for i in self.runs:
            out[i] = inside[i]
        for i in range(len(self.parents) - 1, 0, -1):
            out[self.parents[i]] |= out[i]
        return out


PRIOR = prior()


class Forest:
    """Many pages as arrays, for messages that run level by level over all of them."""

    def __init__(self, pages: list[Page]) -> None:
        base, parents, depth = 0, [], []
        for page in pages:
            level = [0] * len(page.parents)
            for i, p in enumerate(page.parents):
                if p >= 0:
                    level[i] = level[p] + 1
                parents.append(p + base if p >= 0 else -1)
            depth.extend(level)
            base += len(page.parents)
        self.parent, self.depth = np.array(parents, np.int64), np.array(depth, np.int64)
        sizes = [len(f) for page in pages for f in page.features]
        self.owner = np.repeat(np.arange(base), sizes)
        self.feature = np.array([x for page in pages for f in page.features for x in f], np.int64)
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(1, self.depth.max(initial=0) + 2))
        self.levels = np.split(order, cuts[:-1]) if base else []

    def marginals(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of every node, and expected label pairs of parents and children."""
        n = len(self.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(self.owner, model.unary[self.feature], n)
        up, sent = own.copy(), np.zeros((n, 2))
        for level in reversed(self.levels[1:]):
            sent[level] = _log_sum(model.pairs[None] + up[level][:, None, :])
            np.add.at(up, self.parent[level], sent[level])
        down, pair = np.zeros((n, 2)), np.zeros((2, 2))
        for level in self.levels[1:]:
            parent = self.parent[level]
            rest = up[parent] + down[parent] - sent[level]
            joint = rest[:, :, None] + model.pairs[None] + up[level][:, None, :]
            whole = np.exp(joint - joint.max((1, 2), keepdims=True))
            pair += (whole / whole.sum((1, 2), keepdims=True)).sum(0)
            down[level] = _log_sum((rest[:, :, None] + model.pairs[None]).transpose(0, 2, 1))
        odds = np.clip((up + down)[:, 1] - (up + down)[:, 0], -500, 500)
        return 1 / (1 + np.exp(-odds)), pair


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(-1, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(-1, keepdims=True)))[..., 0]


def train(sources: list[str]) -> Model:
    """Maximum a posteriori weights from the pages that label themselves."""
    pages, gold = [], []
    for source in sources:
        page = Page(source)
        labels = page.labels()
        if labels is not None:
            if len(pages) % 2:
                names = {FEATURES[x] for x in LABELLED} | {FEATURES["under:article"]}
                page.features = [[f for f in own if f not in names] for own in page.features]
            pages.append(page)
            gold.append(labels)
    model = prior()
    if not pages:
        return model
    forest, truth = Forest(pages), np.concatenate(gold).astype(float)
    child = forest.parent >= 0
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[forest.parent[child]].astype(int), truth[child].astype(int)), 1)
    past, past_pairs = np.full(len(FEATURES), 1e-6), np.full((2, 2), 1e-6)
    for _ in range(ROUNDS):
        content, pair = forest.marginals(model)
        slope = np.bincount(forest.feature, (truth - content)[forest.owner], len(FEATURES))
        slope = slope / len(pages) - PULL * (model.unary - PRIOR.unary)
        ties = (seen - pair) / len(pages) - PULL * (model.pairs - PRIOR.pairs)
        past, past_pairs = past + slope**2, past_pairs + ties**2
        model = Model(model.unary + RATE * slope / np.sqrt(past),
                      model.pairs + RATE * ties / np.sqrt(past_pairs))
    return model


def extract(model: Model, sources: list[str]) -> list[str]:
    """The main text of each page."""
    pages = [Page(s) for s in sources]
    content, _ = Forest(pages).marginals(model)
    out, base = [], 0
    for page in pages:
        out.append(" ".join(text for i, text in page.runs.items() if content[base + i] >= 0.5))
        base += len(page.parents)
    return out


def fit(pages: DataFrame, key: str = "page_id", source: str = "html") -> Model:
    """Train on the bounded sample of labelled pages.

    Pages are chosen by hashes of id and text; only the chosen ones, each once, reach the driver.
    """
    named = pages.where(F.col(source).rlike(r"(?i)<(?:article|main)\b|articlebody")).select(
        F.xxhash64(F.col(key).cast("string")).alias("_place"),
        F.xxhash64(source).alias("_mark"), F.col(source).alias("_source"))
    marks = ["_place", "_mark"]
    chosen = named.select(marks).distinct().orderBy(marks).limit(PAGES)
    rows = named.join(F.broadcast(chosen), marks).groupBy(marks).agg(
        F.first("_source").alias("_source")).collect()
    return train([r["_source"] for r in sorted(rows, key=lambda r: (r["_place"], r["_mark"]))])


def main_text(pages: DataFrame, model: Model, source: str = "html", keep=("page_id", "url")
              ) -> DataFrame:
    """``(keep…, text)`` of every page."""
    kinds = dict(pages.dtypes)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, source, 2 * 2**20):
                sources = [x or "" for x in part.column(source).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep],
                     pa.array(extract(shared.value, sources), pa.string())],
                    names=[*keep, "text"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string"
    return pages.select(*keep, source).mapInArrow(run, schema)


def op8_tree_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return main_text(pages, fit(pages)).withColumn("n_chars", F.length("text").cast("long"))
