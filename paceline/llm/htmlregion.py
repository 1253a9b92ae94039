"""Main text of HTML pages by a maximum-scoring subsequence.

A page is a sequence of words and tags.  A word scores positive and a tag
negative; how much is learned from pages that mark their content with an
<article> or <main> element: a tag name, the element in which a word stands, and
the class, id and role words of the elements around it get the log odds of
occurring inside against outside the marked element.  A linear scan finds the
contiguous part of the page with the largest sum.  Its text is taken block by
block.

Text is left out of that part in two cases only: it stands in an element that is
never content by its name (scripts, navigation, forms, asides, footers ...), or
the weights of the class words around it are negative.  Usual words for what is
no content (`ad`, `comments`, `cookie` ...) begin with counts against them, which
those of the pages can outweigh; they count only where they are a whole class, id
or role, on containers, and not on html, body, or what holds the marked element.
Where they leave no content at all, the page is scored by the counts of the pages
alone.  What is left out of a marked element does not part the text around it.

The weights are counted on Spark over a bounded sample of pages, so there are no
more of them than the sample has tags and class words; the extraction is one pass
over the rows without a shuffle.

Defined cases: null and empty html give an empty text; html without tags is one
block of text; a page without any positive part gives an empty text; of equal
sums the first part counts; unclosed tags end with their parent or the page;
equal pages give equal texts, however often; a null page_id is passed on; extra
columns are not read; an empty table gives an empty table.  Whole pages are read,
in time in proportion to their length.
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

from .sampling import bounded_sample

#: Pages to learn weights from, at most.
FIT_PAGES = 2_000
#: A word, a tag that has no weight of its own, and such an inline one.
WORD, TAG, INLINE_TAG = 0.5, -0.8, -0.1
#: Words inside and outside marked content that a class word begins with, and one of USUAL.
PRIOR, USUAL_PRIOR = (0.5, 0.5), (0.5, 20.0)

# HTML element names by their part in a page.
RAW = frozenset("script style noscript template svg iframe object canvas textarea select".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow msub msup mfrac msqrt".split()
)
NEVER = frozenset("head title nav footer aside form button dialog menu fieldset".split()) | RAW
MARKED = frozenset("article main".split())
CONTAINERS = frozenset("div section ul ol dl table header center details".split())
USUAL = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer comment comments disqus replies respond notice notices cookie cookies consent popup modal overlay newsletter subscribe "
    "subscription share sharing social related recommended login signup search widget pagination pager toolbar complementary contentinfo".split()
)
#: Of these a part of a class word is enough: readers' comments are never content.
TALK = frozenset("comment comments disqus replies respond".split())
_PARTS = re.compile(r"[-_]+")
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ITEMS = frozenset("li dt dd option tr td th".split())
_HOLDERS = "ul ol dl table select".split()

# A quote counts only as the first sign of a value.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</?([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?|[^>=])*+)(?:>|\Z)", re.DOTALL)
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_SPACE = re.compile(r"\s+")


@dataclass
class Element:
    name: str
    parent: int
    words: frozenset[str]  # of its class, id and role
    never: bool  # it or one around it is never content
    marked: bool  # inside a marked element
    exempt: bool = False  # html, body, a marked element or one around it
    block: int = 0  # the element that names its text's place: itself, or the block around an inline one


@dataclass
class Page:
    """Elements (the page itself first), and pieces in order: (tag, "", element) or ("", text, element)."""

    elements: list[Element]
    pieces: list[tuple[str, str, int]]


def parse(page: str) -> Page:
    """Tags and texts of a page in order, in one pass."""
    elements = [Element("page", -1, frozenset(), False, False, True)]
    pieces: list[tuple[str, str, int]] = []
    stack = [0]
    open_: dict[str, list[int]] = {}  # places in the stack by name
    blocks = [0]  # places in the stack of elements that are not inline

    def close(place: int) -> None:
        while len(stack) > place:
            name = elements[stack.pop()].name
            open_[name].pop()
            if name not in INLINE:
                blocks.pop()

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            pieces.append(("", text, stack[-1]))
        if m is None:
            break
        at = m.end()
        name = (m.group(1) or "").lower()
        if not name:
            continue
        if page[m.start() + 1] == "/":
            here = stack[-1]
            if open_.get(name):
                here = stack[open_[name][-1]]
                close(open_[name][-1])
            pieces.append(("/" + name, "", here))
            continue
        if name in _CLOSES_P and open_.get("p") and blocks[-1] == open_["p"][-1]:
            close(open_["p"][-1])
        if name in _ITEMS and open_.get(name):
            holder = max((open_[x][-1] for x in _HOLDERS if open_.get(x)), default=-1)
            if open_[name][-1] > holder:
                close(open_[name][-1])
        top = elements[stack[-1]]
        words = frozenset(w for g in _NAMES.findall(m.group(2)) for w in "".join(g).lower().split())
        one = Element(name, stack[-1], words, top.never or name in NEVER or (name == "header" and not top.marked), top.marked or name in MARKED)
        one.exempt = name in ("html", "body")
        elements.append(one)
        number = len(elements) - 1
        one.block = top.block if name in INLINE else number
        pieces.append((name, "", number))
        if name in VOID or m.group(0).endswith("/>"):
            continue
        open_.setdefault(name, []).append(len(stack))
        if name not in INLINE:
            blocks.append(len(stack))
        stack.append(number)
        if name in RAW:  # its text is not markup
            end = re.compile(rf"</{name}[\s/>]", re.IGNORECASE).search(page, at)
            at = end.start() if end else n
    holds = [e.name in MARKED for e in elements]
    for number in range(len(elements) - 1, 0, -1):  # an element comes before those in it
        if holds[number]:
            holds[elements[number].parent] = elements[number].exempt = True
    return Page(elements, pieces)


@dataclass
class RegionModel:
    tags: dict[str, float] = field(default_factory=dict)
    places: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=dict)
    seen_words: dict[str, float] = field(default_factory=dict)  # those of USUAL by the counts of the pages alone

    def around(self, elements: list[Element], usual: bool = True) -> list[float]:
        """For each element the least weight of class words around a text in it, or, where none is negative, the nearest."""
        out: list[float] = []
        for e in elements:
            above = out[e.parent] if e.parent >= 0 else 0.0
            own = 0.0 if e.exempt else sum(self.word(w, usual and e.name in CONTAINERS) for w in e.words)
            out.append(min(above, own) if own < 0 or above < 0 else own or above)
        return out

    def word(self, word: str, usual: bool) -> float:
        got = self.words.get(word) if usual else self.seen_words.get(word, self.words.get(word))
        if got is None:
            named = word in USUAL or any(part in TALK for part in _PARTS.split(word))
            return _place_weight(*USUAL_PRIOR) if usual and named else 0.0
        return got

    def region(self, scores: list[float]) -> tuple[int, int]:
        """First and last (behind) place of the part with the largest sum."""
        best, best_at, total, begin = 0.0, (0, 0), 0.0, 0
        for k, score in enumerate(scores):
            if total <= 0:
                total, begin = 0.0, k
            total += score
            if total > best:
                best, best_at = total, (begin, k + 1)
        return best_at

    def extract(self, page: str) -> str:
        """Text of the best region of a page."""
        got = parse(page)
        for usual in (True, False):
            around = self.around(got.elements, usual)
            scores = []
            for tag, text, number in got.pieces:
                e = got.elements[number]
                if e.marked and (e.never or around[number] < 0):
                    scores.append(0.0)  # left out anyway, so it does not part what is around it
                elif tag:
                    # a tag that the sample didn't have says nothing inside marked content
                    unknown = 0.0 if e.marked else INLINE_TAG if e.name in INLINE else TAG
                    scores.append(TAG if e.never else self.tags.get(tag, unknown))
                else:
                    each = -WORD if e.never else WORD + self.places.get(got.elements[e.block].name, 0.0) + around[number]
                    scores.append(len(text.split()) * each)
            text = self._text(got, around, *self.region(scores))
            if text:
                return text
        return ""

    @staticmethod
    def _text(got: Page, around: list[float], first: int, last: int) -> str:
        out, block = [], []

        def flush():
            text = _SPACE.sub(" ", "".join(block)).strip()
            if text:
                out.append(text)
            block.clear()

        for tag, text, number in got.pieces[first:last]:
            if not tag:
                if not got.elements[number].never and around[number] >= 0:
                    block.append(html.unescape(text))
            elif tag.lstrip("/") not in INLINE:
                flush()
        flush()
        return "\n".join(out)


def _place_weight(a: float, b: float) -> float:
    """A word in a usual place of content is worth more, elsewhere less than nothing."""
    odds = math.log(a / b)
    return 0.1 * min(odds, 5.0) if odds > 0 else 0.4 * max(odds, -4.0)


def _tag_weight(a: float, b: float) -> float:
    """Never above zero: tags only cost, those of content less."""
    odds = math.log(a / b)
    return min(-0.05, TAG + 0.6 * odds) if odds > 0 else TAG + 0.4 * max(odds, -3.0)


def _counts(page: str) -> Counter:
    """(kind, name, inside a marked element): tags, and words by the elements and class words around them."""
    got = parse(page)
    seen: Counter = Counter()
    if not any(e.marked for e in got.elements):
        return seen
    n_words = [[0, 0] for _ in got.elements]
    for tag, text, number in got.pieces:
        e = got.elements[number]
        if e.never:
            continue  # never content, whatever the weights
        if tag:
            seen["tag", tag, e.marked] += 1
        else:
            n = len(text.split())
            seen["place", got.elements[e.block].name, e.marked] += n
            n_words[number][e.marked] += n
    for number in range(len(got.elements) - 1, 0, -1):  # an element comes before those in it
        e = got.elements[number]
        for inside in (0, 1):
            n_words[e.parent][inside] += n_words[number][inside]
            if n_words[number][inside] and not (e.exempt and e.name not in MARKED):
                for word in e.words:
                    seen["word", word, bool(inside)] += n_words[number][inside]
    return seen


def _count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        seen: Counter = Counter()
        for page in part.column(0).to_pylist():
            seen.update(_counts(page or ""))
        if seen:
            kinds, names, inside = zip(*seen, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(names, pa.string()), pa.array(inside, pa.bool_()), pa.array(seen.values(), pa.int64())], ["kind", "name", "inside", "n"])


def learn(pages: DataFrame, html_column: str = "html", key: str = "page_id", fit_pages: int = FIT_PAGES) -> RegionModel:
    """Weights from the pages that mark their content, in a sample of `fit_pages` at most."""
    sample = bounded_sample(pages.where(F.col(html_column).isNotNull()).select(key, html_column), (key, html_column), fit_pages)
    counts = sample.select(html_column).mapInArrow(_count, "kind string, name string, inside boolean, n long")
    rows = counts.groupBy("kind", "name").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("b"))
    model = RegionModel()
    for r in rows.collect():  # tags and class words of the sample's pages
        if r["kind"] == "tag":
            model.tags[r["name"]] = _tag_weight(r["a"] + 0.5, r["b"] + 0.5)
        else:
            usual = r["kind"] == "word" and r["name"] in USUAL
            a, b = USUAL_PRIOR if usual else PRIOR
            if usual:
                model.seen_words[r["name"]] = _place_weight(r["a"] + PRIOR[0], r["b"] + PRIOR[1])
            (model.places if r["kind"] == "place" else model.words)[r["name"]] = _place_weight(r["a"] + a, r["b"] + b)
    return model


def extract(pages: DataFrame, model: RegionModel, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The `keep` columns, text and n_chars of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # weights of a sample of bounded size

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(0, part.num_rows, 500):
                cut = part.slice(k, 500)
                texts = [shared.value.extract(x or "") for x in cut.column(len(keep)).to_pylist()]
                arrays = [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(cut.column(i) for i in range(len(keep))), *arrays], [*keep, "text", "n_chars"])

    picked = pages.select(*keep, F.col(html_column).alias("html_"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(keep)])
    return picked.mapInArrow(run, f"{kept}, text string, n_chars long")
