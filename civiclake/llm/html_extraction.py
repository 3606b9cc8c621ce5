"""HTML extraction: the main text of a page is its maximum-scoring run of words and tags.

A page is read as a sequence: words score positive, tags negative, and one linear scan finds the contiguous run with the greatest sum. The
weights come from labelled pages: log-odds of a word's place (inside an article mark or not, in a link or not), of each tag or class for
lying within the main text, and a factor on the tags' weights chosen by the F1 of the labelled pages' words. A subtree that is no part of
an article wherever it stands (menus, adverts, forms, comments) is one negative token without words: the scan may pass
over it, its text is never taken. Which subtrees these are is learned alike, for tag names and for class, id and role words; the fixed
lists below count as earlier observations.

A label is the main text itself, or, where none is given, the page's only ``article`` (else only ``main``) element. There are two sets
of weights, the second learned from the same pages as if that element were a ``div``; it is used for pages without such a mark.

Text: character references are decoded, white space inside a block becomes one space, blocks are joined by one space. A block at the
edge of the run is taken whole. Inline tags do not part words; ``br`` does.

Defined results: a null or empty page has an empty text, as has one without words; of equal sums the first run is taken, and of those the longest;
tags left open end with their parent, a paragraph with the next block; a tag or comment cut off at the page's end is dropped; a ``<`` that
begins no tag is text; repeated rows come out alike; without labelled pages the fixed lists alone decide; other columns are passed by.
Learning reads about ``max_labelled`` labelled pages drawn by hash, and only counts of names and classes reach the driver.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# HTML's element names by what they mean, and words that mark up parts around an article.
MARKS = ("article", "main")
FRAME = frozenset(("html", "body", *MARKS))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
RAW = frozenset(("script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"))
INLINE = frozenset((
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"))
AROUND = frozenset((
    "head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "datalist", "fieldset", "label", "svg", "math", "canvas",
    "object", "audio", "video", "map", *RAW))
AROUND_WORDS = frozenset((
    "ad", "ads", "adbox", "adsense", "advert", "adverts", "advertisement", "alert", "banner", "breadcrumb", "breadcrumbs", "byline-share", "comment", "comments", "commentlist",
    "complementary", "consent", "contentinfo", "cookie", "cookies", "dialog", "disqus", "feedback", "footer", "gdpr", "header", "login", "masthead", "menu", "modal",
    "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager", "pagination", "popup", "promo", "promotion", "related",
    "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "widgets"))
#: Next to these, a word above names a property of the page, or the head of an article.
NEUTRAL_WORDS = frozenset(("has", "no", "with", "without", "article", "entry", "post", "story", "content"))

_TAG = re.compile(r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table"))}
TEXT, OPEN, CLOSE = range(3)


@dataclass
class Element:
    name: str
    words: tuple[str, ...]
    parent: int
    marked: bool
    link: bool
    holds_mark: bool = False

    def features(self) -> list[str]:
        """What may tell that it is no part of an article: words of class, id and role, and names that stand for such parts.
        Other names say nothing: lists and links occur in articles too."""
        names = [self.name] if self.name in AROUND and not (self.name == "header" and self.marked) else []
        return names + ([] if NEUTRAL_WORDS.intersection(self.words) else [f".{w}" for w in self.words])

    @property
    def key(self) -> str:
        """What its tags are counted under: its first class word, else its name."""
        return f".{self.words[0]}" if self.words and self.name not in FRAME else self.name


@dataclass
class Page:
    """Elements (parents first) and tokens ``(kind, element, text)`` in page order."""

    elements: list[Element] = field(default_factory=list)
    tokens: list[tuple[int, int, str]] = field(default_factory=list)

    def marks(self) -> list[int]:
        """The one element that marks the main text, or nothing."""
        for name in MARKS:
            found = [i for i, e in enumerate(self.elements) if e.name == name]
            if len(found) == 1:
                return found
        return []


def _named(attributes: str) -> tuple[str, ...]:
    words = dict.fromkeys(w for m in _NAMED.finditer(attributes) for w in _WORD.findall((m[2] or m[3] or m[4] or "").lower()))
    return tuple(words)


def parse(source: str) -> Page:
    page = Page([Element("", (), -1, False, False)])
    elements, tokens, stack, at = page.elements, page.tokens, [0], 0
    opened: Counter = Counter()

    def close_to(name: str, barrier: tuple[str, ...] = ()) -> None:
        if not opened[name]:
            return
        if barrier:
            for i in reversed(stack):
                if elements[i].name == name:
                    break
                if elements[i].name in barrier:
                    return
        while True:
            i = stack.pop()
            opened[elements[i].name] -= 1
            tokens.append((CLOSE, i, ""))
            if elements[i].name == name:
                return

    while at < len(source):
        m = _TAG.search(source, at)
        if m is None:
            tokens.append((TEXT, stack[-1], source[at:]))
            break
        if m.start() > at:
            tokens.append((TEXT, stack[-1], source[at:m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name not in INLINE or opened[name]:
                close_to(name)
            continue
        if name not in INLINE:
            close_to("p", ("button", "td", "th", "caption"))
        if name in _CLOSES:
            close_to(*_CLOSES[name])
        elif name == "a":
            close_to("a", ("td", "th", "li"))
        words = _named(m[3]) if m[3] else ()
        above = elements[stack[-1]]
        number = len(elements)
        elements.append(Element(name, words, stack[-1], above.marked or name in MARKS, above.link or name == "a"))
        tokens.append((OPEN, number, ""))
        if name in MARKS:
            for i in reversed(stack):
                if elements[i].holds_mark:
                    break
                elements[i].holds_mark = True
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
            at = len(source) if end is None else source.find(">", end.end()) + 1 or len(source)
        elif name not in VOID and (name not in INLINE or name == "a" or words):
            stack.append(number)
            opened[name] += 1
    return page


@dataclass
class Weights:
    """``places``: log-odds of names and ``.words`` for holding main text; ``tags`` and ``words`` by whether the page is marked."""

    places: dict[str, float] = field(default_factory=dict)
    tags: dict[tuple[bool, str], float] = field(default_factory=dict)
    words: dict[tuple[bool, bool, bool], float] = field(default_factory=dict)
    factor: dict[bool, float] = field(default_factory=lambda: {True: 1.0, False: 1.0})
    #: A subtree below this is not part of any article; passing over it costs this much; the least cost of a tag and the bounds of a word.
    outside: float = -3.5
    crossing: float = 0.5
    least_tag: float = 0.2
    word_range: tuple[float, float] = (0.05, 3.0)

    def tag(self, marked: bool, key: str) -> float:
        return -(self.least_tag + self.factor[marked] * max(0.0, -self.tags.get((marked, key), 0.0)))

    def word(self, marked: bool, inside: bool, link: bool) -> float:
        low, high = self.word_range
        return min(high, max(low, self.words.get((marked, inside, link), -1.0 if link and not inside else 1.0)))

    def place(self, feature: str) -> float:
        return self.places.get(feature, _log_odds(0, 0, feature))


def _log_odds(inside: float, outside: float, feature: str = "") -> float:
    """The fixed lists weigh as much as 50 words seen outside."""
    known = feature in AROUND or feature[:1] == "." and feature[1:] in AROUND_WORDS
    return math.log((inside + 0.5) / (outside + 0.5 + 50 * known))


def around(page: Page, weights: Weights) -> list[bool]:
    """For each element whether its subtree is no part of an article."""
    out: list[bool] = []
    for e in page.elements:
        bad = e.parent >= 0 and out[e.parent]
        if not bad and e.name not in FRAME and not e.holds_mark and e.parent >= 0:
            bad = any(weights.place(f) < weights.outside for f in e.features())
        out.append(bad)
    return out


def scores(page: Page, bad: list[bool], weights: Weights, marked: bool) -> list[float]:
    """A score for each token; tokens inside of passed-over subtrees score nothing."""
    out = []
    for kind, i, text in page.tokens:
        e = page.elements[i]
        if bad[i]:
            out.append(-weights.crossing if kind == OPEN and not bad[e.parent] else 0.0)
        elif kind == TEXT:
            n = len(html.unescape(text).split())
            out.append(n * weights.word(marked, marked and e.marked, e.link) if n else 0.0)
        else:
            key = e.key if marked or e.name not in MARKS else "div"
            out.append(weights.tag(marked, key))
    return out


def best_run(values: list[float]) -> tuple[int, int]:
    """The bounds of the contiguous run with the greatest positive sum, by one scan; (0, 0) if there is none."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for i, v in enumerate(values):
        if total <= 0:
            total, start = 0.0, i
        total += v
        if total > best or (total == best and start == bounds[0] and total > 0):
            best, bounds = total, (start, i + 1)
    return bounds


def blocks(page: Page, bad: list[bool]) -> Iterator[tuple[list[int], str]]:
    """Text blocks: the numbers of their tokens, and their text."""
    held: list[int] = []
    for n, (kind, i, _) in enumerate(page.tokens):
        if kind == TEXT:
            if not bad[i]:
                held.append(n)
        elif page.elements[i].name not in INLINE and held:
            yield held, " ".join("".join(html.unescape(page.tokens[k][2]) for k in held).split())
            held = []
    if held:
        yield held, " ".join("".join(html.unescape(page.tokens[k][2]) for k in held).split())


def main_text(source: str | None, weights: Weights) -> str:
    if not source:
        return ""
    page = parse(source)
    bad = around(page, weights)
    start, end = best_run(scores(page, bad, weights, bool(page.marks())))
    return " ".join(text for at, text in blocks(page, bad) if text and at[-1] >= start and at[0] < end)


def labelled_tokens(page: Page, bad: list[bool], gold: str | None) -> list[bool] | None:
    """For each token whether it is main text; None for a page without a label."""
    out = [False] * len(page.tokens)
    if gold is not None:
        whole = " ".join(gold.split())
        for at, text in blocks(page, [False] * len(bad)):
            if text and text in whole:
                for k in at:
                    out[k] = True
        return out
    marks = page.marks()
    if not marks:
        return None
    inside = [False] * len(page.elements)
    for i, e in enumerate(page.elements):
        inside[i] = i == marks[0] or (e.parent >= 0 and inside[e.parent])
    return [kind == TEXT and inside[i] and not bad[i] for kind, i, _ in page.tokens]


def observe(source: str, gold: str | None) -> Counter | None:
    """What one labelled page shows: ``(table, marked, feature, inside)`` and how often."""
    page, prior = parse(source), Weights()
    bad = around(page, prior)
    label = labelled_tokens(page, bad, gold)
    if label is None or not any(label):
        return None
    seen: Counter = Counter()
    last = len(label) - label[::-1].index(True)
    first = label.index(True)
    for n, (kind, i, text) in enumerate(page.tokens):
        e = page.elements[i]
        if kind == TEXT:
            words = len(html.unescape(text).split())
            if not words:
                continue
            features = set()
            up = i
            while up > 0:
                x = page.elements[up]
                if x.name not in FRAME and not x.holds_mark:
                    features.update(x.features())
                up = x.parent
            for f in features:
                seen["place", False, f, label[n]] += words
            if not bad[i]:
                for marked in (False, True):
                    seen["word", marked, f"{int(marked and e.marked)}{int(e.link)}", label[n]] += words
        elif not bad[i]:
            for marked in (False, True):
                key = e.key if marked or e.name not in MARKS else "div"
                seen["tag", marked, key, first < n < last] += 1
    return seen


def weights_of(seen: dict[tuple, float]) -> Weights:
    """Log-odds of what labelled pages show. Links outside of marks begin with an observation against them."""
    out = Weights()
    for table, marked, feature in {k[:3] for k in seen}:
        inside, outside = seen.get((table, marked, feature, True), 0), seen.get((table, marked, feature, False), 0)
        if table == "place":
            out.places[feature] = _log_odds(inside, outside, feature)
        elif table == "tag":
            out.tags[marked, feature] = _log_odds(inside, outside)
        else:
            within, link = feature[0] == "1", feature[1] == "1"
            out.words[marked, within, link] = _log_odds(inside + (0 if link and not within else 2), outside + 2 * (link and not within))
    return out


FACTORS = (0.125, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0)
_SEEN = T.StructType([T.StructField("table", T.StringType()), T.StructField("marked", T.BooleanType()), T.StructField("feature", T.StringType()),
                      T.StructField("inside", T.BooleanType()), T.StructField("n", T.LongType())])
_FIT = T.StructType([T.StructField("marked", T.BooleanType()), T.StructField("number", T.IntegerType()),
                     *[T.StructField(n, T.LongType()) for n in ("both", "found", "wanted")]])


def learn(pages: DataFrame, *, html_col: str = "html", label_col: str | None = None, max_labelled: int = 5_000) -> Weights:
    """Weights from labelled pages, about ``max_labelled`` of them. Pages are counted in their tasks; features are summed by Spark."""
    gold = pages[label_col].cast("string") if label_col else F.lit(None).cast("string")
    source = pages.select(pages[html_col].alias("html"), gold.alias("gold")).where(F.coalesce(F.col("html"), F.lit("")) != "")
    shown = F.lower("html")
    labelled = source.where(F.col("gold").isNotNull() | F.greatest(*[shown.contains(f"<{m}") for m in MARKS]))
    share = 1_000_000 * max_labelled // max(1, labelled.count())
    sample = labelled.where(F.pmod(F.xxhash64("html", "gold"), F.lit(1_000_000)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for source_, gold_ in zip(batch.column("html"), batch.column("gold")):
                seen.update(observe(source_.as_py(), gold_.as_py()) or {})
            rows = [(*k, n) for k, n in seen.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], _SEEN.names)

    counted = sample.mapInArrow(count, _SEEN).groupBy("table", "marked", "feature", "inside").agg(F.sum("n").alias("n"))
    weights = weights_of({(r["table"], r["marked"], r["feature"], r["inside"]): r["n"] for r in counted.collect()})

    def try_factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits: Counter = Counter()
        for batch in batches:
            for source_, gold_ in zip(batch.column("html"), batch.column("gold")):
                page = parse(source_.as_py())
                bad = around(page, weights)
                label = labelled_tokens(page, bad, gold_.as_py())
                if label is None:
                    continue
                words = [len(html.unescape(t).split()) if kind == TEXT and not bad[i] else 0 for kind, i, t in page.tokens]
                wanted = sum(w for w, inside in zip(words, label) if inside)
                for marked in (False, True):
                    for k, factor in enumerate(FACTORS):
                        trial = Weights(weights.places, weights.tags, weights.words, {marked: factor})
                        a, b = best_run(scores(page, bad, trial, marked))
                        for name, n in (("both", sum(w for w, inside in zip(words[a:b], label[a:b]) if inside)), ("found", sum(words[a:b])), ("wanted", wanted)):
                            hits[marked, k, name] += n
        rows = [(m, k, *[hits[m, k, n] for n in ("both", "found", "wanted")]) for m in (False, True) for k in range(len(FACTORS))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.bool_(), pa.int32(), *[pa.int64()] * 3))], _FIT.names)

    totals = sample.mapInArrow(try_factors, _FIT).groupBy("marked", "number").agg(*[F.sum(n).alias(n) for n in ("both", "found", "wanted")]).collect()
    for marked in (False, True):
        f1 = {r["number"]: 2 * r["both"] / max(1, r["found"] + r["wanted"]) for r in totals if r["marked"] == marked}
        best = [k for k, v in sorted(f1.items()) if v >= max(f1.values()) - 1e-9]
        if best:  # a mark is a firm border; without one, tags should not part a text more than they must
            weights.factor[marked] = FACTORS[best[-1] if marked else best[0]]
    return weights


def extract(pages: DataFrame, weights: Weights, *, html_col: str = "html") -> DataFrame:
    """``_row`` (the page) and ``_text``, its main text."""
    def batch(sources: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py(), weights) for x in sources], pa.string())

    return pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("_row"), F.arrow_udf(batch, T.StringType())(pages[html_col]).alias("_text"))
