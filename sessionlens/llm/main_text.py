"""The main text of web pages, as the maximum-scoring run of words and tags.

A page is a sequence of words and tags. Each word has a weight by where it stands (the block around it, whether it
is a link, whether the page marks the place as menu, advert, comment and the like), each tag one by its name; tags
count against a run. One pass over the page finds the contiguous run with the largest sum, and the text of its
blocks, but for the marked places inside, is the result.

Weights are log odds learned from the pages of the table that label their text themselves, by one article or main
element with most of their words: words and tags in unmarked places are counted inside and outside of it, by grouped
aggregation, on top of a prior. On those pages the label is one more weight, as large as the odds of its words against
the others; the run decides there as on all other pages, and all unmarked text of it is kept, inside the label or not.

Places are marked by tags, roles and names. A name that says what an element has or allows (has-sidebar, comments-open)
marks nothing, and an element marked by its name alone that holds three quarters of the page's words is taken for a
wrapper, unless the page labels text outside of it. Marked words count nothing: a run goes past them, without their text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import slices

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot "
    "thead tr ul".split()
)
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr",)), "th": ("th", ("tr",)), "option": ("option", ("select",))}

# Elements and names that mark a place as no part of the article.
ASIDE = frozenset("aside button dialog footer form head iframe input menu nav noscript object script select style svg template textarea".split())
MARKS = frozenset(
    "ad ads adslot advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted "
    "promotion recommended related replies respond search share sharing sidebar signup social sponsor sponsored subscribe ticker toolbar "
    "topbar widget".split()
)
STATES = frozenset("has have with without no not is open opened closed enabled disabled active allowed".split())  # in names of elements that are something else
TITLES = frozenset("article content entry post section story".split())  # whose headers are part of the article
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
HOLDERS = frozenset("html body main article".split())  # never marked by their names

FAVOUR = 3.0  # the most that the label of a page adds to words inside, and takes from those outside
LEAST_SHARE = 0.5  # of the unmarked words, for one element to label a page
LIMIT = 4.0
MOST = 0.75  # of the words of a page, for an element marked by its name to be a wrapper

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def marked(name: str, attributes: str, labelled: bool) -> str:
    """Whether an element is no part of the article by its tag or role ("tag") or by its name only ("name"), else "".

    ``labelled`` if it stands inside an article or main element.
    """
    if name in ASIDE:
        return "tag"
    if name in HOLDERS and name != "article":
        return ""
    by = "name" if name == "header" and not labelled else ""
    for key, *value in _NAMED.findall(attributes):
        value = "".join(value)
        if key.lower() == "role":
            if value.strip().lower() in ROLES:
                return "tag"
        else:
            every = {p.lower() for p in _PARTS.findall(value)}
            for token in value.split():
                parts = {p.lower() for p in _PARTS.findall(token)}
                if not parts & STATES and (parts & MARKS or ("header" in parts and not every & TITLES)):
                    by = "name"
    return by


@dataclass
class Piece:
    """A run of text in one place, or a tag (``text`` is None)."""

    feature: str
    text: str | None
    block: int
    marked: bool
    article: int  # the outermost article and main around it, by number; 0 if none
    main: int
    named: int  # the innermost element around it that is marked by its name, by number; 0 if none


def pieces(page: str) -> list[Piece]:
    """The words and tags of a page in order. Elements that are never closed end with what is around them."""
    out: list[Piece] = []
    stack: list[tuple[str, bool, int]] = []  # name, marked by tag or inside such, innermost element marked by name
    enclosing: dict[int, int] = {0: 0}  # such elements, and the next one around each
    labels: dict[str, list[int]] = {"article": [], "main": []}  # the open ones, numbered as they begin
    held, block, at, begun = Counter(), 0, 0, 0

    def close(to: int) -> None:
        while len(stack) > to:
            name = stack.pop()[0]
            held[name] -= 1
            if name in labels:
                labels[name].pop()

    def outermost(kind: str) -> int:
        return labels[kind][0] if labels[kind] else 0

    def place_of() -> tuple[bool, int, int, int]:
        return bool(stack) and stack[-1][1], outermost("article"), outermost("main"), stack[-1][2] if stack else 0

    def last(names: tuple[str, ...]) -> int:
        return next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in names), -1)

    def text(raw: str) -> None:
        if raw and not raw.isspace():
            place = next((n for n, _, _ in reversed(stack) if n in BLOCKS), "body")
            out.append(Piece(place + (" link" if held["a"] else ""), entities.unescape(raw), block, *place_of()))
        elif raw and out and out[-1].text is not None:
            out[-1].text += " "

    while at < len(page):
        found = _TOKEN.search(page, at)
        text(page[at : found.start()] if found else page[at:])
        if not found:
            break
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            block += 1
        elif name in ("br", "td", "th") and out and out[-1].text is not None:
            out[-1].text += " "
        if found[1] or found[4]:
            if held[name]:
                close(last((name,)))
        else:
            if name in BLOCKS and held["p"] and (i := last(("p", "div", "td", "li", "article", "section", "blockquote"))) >= 0 and stack[i][0] == "p":
                close(i)
            if name in CLOSES:
                same, around = CLOSES[name]
                if held[same] and (i := last((same, *around))) >= 0 and stack[i][0] == same:
                    close(i)
            inside, named = stack[-1][1:] if stack else (False, 0)
            if name not in VOID:
                by = marked(name, found[3] or found[6] or "", held["article"] + held["main"] > 0)
                bad = inside or by == "tag"
                if by == "name":
                    begun += 1
                    enclosing[begun], named = named, begun
                kind = name if not (bad and name in ("article", "main")) else "section"  # a comment, say, is no label
                if name in RAW:
                    end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                    at = end.end() if end else len(page)
                    continue
                stack.append((kind, bad, named))
                held[kind] += 1
                if kind in labels:
                    begun += 1
                    labels[kind].append(begun)
        if name in HOLDERS or name in ("head", "meta", "link", "base"):
            continue
        out.append(Piece(name if name in BLOCKS else "inline", None, block, *place_of()))
    _mark_names(out, enclosing)
    return out


def _mark_names(items: list[Piece], around: dict[int, int]) -> None:
    """Marks what is inside elements with marked names, but for those that are wrappers."""
    words, labelled = Counter(), 0
    for p in items:
        if p.text is not None and not p.marked:
            n = len(p.text.split())
            words[p.named] += n
            if not p.named and (p.article or p.main):
                labelled += n
    total = sum(words.values())
    for number in sorted(around, reverse=True)[:-1]:  # elements have higher numbers than what is around them
        if around[number]:
            words[around[number]] += words[number]
    out = {0: False}
    for number in sorted(around)[1:]:
        out[number] = out[around[number]] or labelled > 0 or words[number] < MOST * total
    for p in items:
        p.marked = p.marked or out[p.named]


def label_of(items: list[Piece]) -> tuple[str, int, float]:
    """The element that holds most of this page's words, by kind and number ("" if none), and its weight.

    Of several articles, as in a list of teasers, the one with most words is looked at, then main in the same way.
    """
    words = {"article": Counter(), "main": Counter()}
    total = 0
    for p in items:
        if p.text is not None and not p.marked:
            n = len(p.text.split())
            total += n
            words["article"][p.article] += n
            words["main"][p.main] += n
    for kind, found in words.items():
        found.pop(0, None)
        if found:
            number, n = found.most_common(1)[0]
            if n >= LEAST_SHARE * total > 0:
                return kind, number, min(FAVOUR, float(np.log((n + 1) / (total - n + 1))))
    return "", 0, 0.0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (w) and tags (t) by feature, inside and outside the labelling element. Features are few."""
    counts: Counter = Counter()
    for batch in slices(batches, 256):
        for page in batch.column("html").to_pylist():
            items = pieces(page or "")
            kind, number, _ = label_of(items)
            if kind:
                for p in items:
                    if not p.marked:
                        counts[("w " if p.text is not None else "t ") + p.feature, getattr(p, kind) == number] += len(p.text.split()) if p.text is not None else 1
    keys = list(counts)
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([counts[k] for k in keys], pa.int64())], ["feature", "inside", "n"])


class Weights:
    """Log odds of features, from counts on top of a prior: words are text, links and tags are not."""

    def __init__(self, counts: dict[tuple[str, bool], int]):
        self.value = {}
        total = {inside: sum(n for (f, i), n in counts.items() if i == inside and f[0] == "w") for inside in (True, False)}
        scale = (total[False] + 1) / (total[True] + 1)  # pages with long texts say no more than others
        for feature in {f for f, _ in counts}:
            a, b = self._prior(feature)
            odds = float(np.log((counts.get((feature, True), 0) * min(1.0, scale) + a) / (counts.get((feature, False), 0) + b)))
            self.value[feature] = min(-0.1, max(-1.0, odds)) if feature[0] == "t" else max(-LIMIT, min(LIMIT, odds))

    @staticmethod
    def _prior(feature: str) -> tuple[float, float]:
        return (20.0, 25.0) if feature[0] == "t" else (20.0, 60.0) if feature.endswith("link") else (60.0, 20.0)

    def of(self, feature: str) -> float:
        a, b = self._prior(feature)
        return self.value.get(feature, float(np.log(a / b)))


def main_text(page: str, weights: Weights) -> str:
    """The blocks of the best run, one to a line."""
    items = pieces(page)
    kind, number, lean = label_of(items)
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, p in enumerate(items):
        inside = bool(kind) and getattr(p, kind) == number
        if p.text is None:
            score = weights.of("t " + p.feature)
            score = min(0.0, score + lean) if inside else score
        elif p.marked:
            score = 0.0
        else:
            score = len(p.text.split()) * (weights.of("w " + p.feature) + (lean if inside else -lean))
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, span = total, (start, i + 1)
    blocks: dict[int, list[str]] = {}
    for p in items[slice(*span)]:
        if p.text is not None and not p.marked:
            blocks.setdefault(p.block, []).append(p.text)
    lines = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n".join(x for x in lines if x)


def extract_main_text(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    Null and empty pages, and pages without words, give an empty text. Broken markup is read as far as it goes.
    Repeated rows stay repeated. Ids and addresses are passed on as they are, null too; other columns are not looked
    at. Without pages that label their text the prior alone decides. An empty table gives an empty result.
    """
    only = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    counted = only.select("html").mapInArrow(_count, "feature string, inside boolean, n long").groupBy("feature", "inside").agg(F.sum("n").alias("n"))
    weights = Weights({(r.feature, r.inside): r.n for r in counted.collect()})  # a row for each tag name

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            texts = [main_text(page or "", weights) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return only.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
