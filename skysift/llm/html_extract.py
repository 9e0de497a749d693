"""Main text of HTML pages by the maximum-scoring subsequence.

A page becomes a sequence of blocks (words between block tags) and the tags between them. Words score
positive, tags and words of menus, adverts and the like negative; a linear scan finds the contiguous region
of the greatest sum, whole blocks being kept together. The weights come from labelled pages: every page whose
author marked the article with <article> counts, for each tag and kind of word, how often it stands inside
and outside; grouped aggregation over the whole table adds the counts up, and their log-odds are the weights.
All pages, marked or not, are then judged by these weights alone: an <article> is a label when the weights are
fitted, and one more tag when a page is extracted. Words are of two kinds: those of menus, adverts, forms,
notices, comments and so on, known by their elements or by names (class, id, role) made of listed words, and
all others. The kind is a feature like a tag: its weight is learned, blocks of a kind that scores negative are
left out of the region, and the tags inside such parts don't count again.

Defined results: null or empty html, and pages without content words, give an empty text. Unclosed elements
end with the block that cannot hold them or with the page; an unclosed comment, script or style hides the
rest, while elements with a longer name of their own (svg-icon) are elements like any other. Character
references are decoded once. Repeated pages are extracted alike, and of equally good regions the first counts. Pages
of any length and depth take time in proportion to their length. A column by the name of the result is replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysift.llm.common import let_workers_import

RAW = "script|style|noscript|template|textarea|iframe|svg|math|object|title|xmp|noembed|noframes"
TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold the article's text.
ASIDE = frozenset("nav footer aside form button select option menu dialog head input label fieldset audio video canvas map search".split())
#: The same by words of class, id or role.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus dialog footer gdpr header hidden login masthead menu menubar "
    "modal nav navbar navigation navigationbar newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promoted promotion promotions recommended recommendations related replies reply respond search share sharing sidebar "
    "signup skip social sponsor sponsored sponsors subscribe subscription taboola toc toolbar widget widgets contentinfo complementary alert alertdialog".split()
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: These close an open paragraph.
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "head"}
FEATURES = BLOCKS | VOID | {"a", "b", "strong", "i", "em", "u", "s", "span", "code", "q", "cite", "small", "sub", "sup", "font", "time", "abbr", "mark", "other"}


#: Words that may stand beside those in a name without changing what it is.
FILLER = frozenset("area bar block body bottom box center column container content div group heading holder inner item items large layer left link links list middle outer page panel placeholder region right row section side site slot small text top unit wrap wrapper".split())
#: Articles that aren't the page's own; hidden elements.
NOT_OWN = frozenset("comment comments reply ad advert related teaser".split())
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)


def _aside(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is of a kind that isn't the article's text. A class, id or role counts if it is made of listed and filling words only."""
    if name in ASIDE or name == "header" and not in_article:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    names = [[w for w in re.split(r"[^a-z]+", n) if len(w) > 1] for found in NAMED.findall(attributes) for n in "".join(found).lower().split()]
    listed = NOT_OWN if name == "article" else ASIDE_WORDS
    if any(any(w in listed for w in n) and all(w in listed or w in FILLER for w in n) for n in names):
        return True
    return name != "article" and HIDDEN.search(attributes) is not None


class _Open:
    """The open elements, with the places of each name and of the blocks among them, so that each tag takes constant time."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool]] = []  # name, aside, article
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.asides = self.articles = 0

    def push(self, name: str, aside: bool) -> None:
        own = name == "article" and not aside
        self.places.setdefault(name, []).append(len(self.stack))
        if name in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((name, aside, own))
        self.asides += aside
        self.articles += own

    def last(self, name: str) -> int | None:
        places = self.places.get(name)
        return places[-1] if places else None

    def pop(self, to: int | None) -> None:
        """Close the elements from a place on."""
        while to is not None and len(self.stack) > to:
            name, aside, own = self.stack.pop()
            self.places[name].pop()
            if name in BLOCKS:
                self.blocks.pop()
            self.asides -= aside
            self.articles -= own


#: An element ends an open one beside it of these names.
ENDS = {"li": ("li",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}


def parts(page: str) -> list[tuple]:
    """The page as ("tag", name, inside, aside) and ("text", raw text, kind, inside), kind being word or aside.

    inside tells whether an <article> (or else <main>) is open.
    """
    out: list[tuple] = []
    now = _Open()
    at = 0
    for m in TAG.finditer(page):
        if m.start() > at:
            out.append(("text", page[at : m.start()], "aside" if now.asides else "word", now.articles > 0))
        at = m.end()
        name = (m[3] or "").lower()
        if m[1]:
            out.append(("tag", "other", now.articles > 0, now.asides > 0))
        if not name:
            continue
        top = now.blocks[-1] if now.blocks else -1  # the innermost open block
        if m[2]:
            if name in BLOCKS or name in FEATURES:
                out.append(("tag", name, now.articles > 0, now.asides > 0))
            place = now.last(name)
            if name in BLOCKS or place is not None and place > top:  # an inline end tag doesn't close blocks
                now.pop(place)
            continue
        if name in ENDS_P and top >= 0 and now.stack[top][0] == "p":
            now.pop(top)
        if now.stack and now.stack[-1][0] in ENDS.get(name, ()):
            now.pop(len(now.stack) - 1)
        if name in ("body", "article", "main"):
            now.pop(now.last("head"))
        if name not in VOID and not (m[4] or "").endswith("/"):
            now.push(name, _aside(name, m[4] or "", now.articles > 0))
        out.append(("tag", name if name in FEATURES else "other", now.articles > 0, now.asides > 0))
    if at < len(page):
        out.append(("text", page[at:], "aside" if now.asides else "word", now.articles > 0))
    return out


def blocks(page: str) -> tuple[list[tuple], bool]:
    """("block", text, words, kind, inside) and ("tag", name, inside, aside) in page order; whether an article is marked."""
    out: list[tuple] = []
    held: list[str] = []
    state = ("word", False)

    def end() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(("block", text, text.count(" ") + 1, *state))
            held.clear()

    marked = False
    for x in parts(page):
        if x[0] == "text":
            if held and (x[2], x[3]) != state:
                end()
            state = (x[2], x[3])
            marked |= x[3]
            held.append(x[1])
        else:
            if x[1] in BLOCKS:
                end()
            elif x[1] == "br" and held:
                held.append(" ")
            out.append(x)
    end()
    return out, marked


def tag_counts(page: str) -> Counter:
    """(feature, inside) of a page that marks its article."""
    seq, marked = blocks(page)
    counts: Counter = Counter()
    if marked:
        for x in seq:
            if x[0] == "tag":
                counts[x[1], x[2]] += 1
            else:
                counts[f"words:{x[3]}", x[4]] += x[2]
    return counts


def weights(pages: DataFrame, column: str = "html") -> dict[str, float]:
    """Weights from all pages that mark their article. Features are tag names of a fixed list and two kinds of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                counts.update(tag_counts(page or ""))
        keys = sorted(counts)
        yield pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([counts[k] for k in keys], pa.int64())], names=["feature", "inside", "n"])

    let_workers_import(pages.sparkSession)
    found = pages.select(F.col(column)).mapInArrow(run, "feature string, inside boolean, n long").groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect()
    return to_weights({(r.feature, r.inside): r.n for r in found})


def to_weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log-odds of standing inside, over words and over tags apart; words are kept positive and tags negative."""
    out = {"words:word": 1.0, "words:aside": -0.2}
    for kind in ("words", "tags"):
        names = {f for f, _ in counts if f.startswith("words:") == (kind == "words")}
        total = {s: sum(counts.get((f, s), 0) for f in names) + len(names) for s in (True, False)}
        for f in names:
            odds = math.log((counts.get((f, True), 0) + 1) / total[True]) - math.log((counts.get((f, False), 0) + 1) / total[False])
            out[f] = max(0.5, min(3.0, odds)) if f == "words:word" else max(-0.5, min(-0.05, odds)) if f == "words:aside" else max(-3.0, min(-0.02, odds))
    return out


def region(scores: list[float]) -> tuple[int, int]:
    """The first and shortest of the contiguous ranges with the greatest sum; empty if no sum is positive."""
    total, start, best, found = 0.0, 0, 0.0, (0, 0)
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str | None, weight: dict[str, float]) -> str:
    """The blocks of the best region whose words score positive, one on each line."""
    seq, _ = blocks(page or "")
    word = {kind: weight.get(f"words:{kind}", 0.0) for kind in ("word", "aside")}
    # the tags of an aside part don't count beside its words
    scores = [x[2] * word[x[3]] if x[0] == "block" else 0.0 if x[3] else weight.get(x[1], -0.5) for x in seq]
    return "\n".join(x[1] for x in seq[slice(*region(scores))] if x[0] == "block" and word[x[3]] > 0)


def extract(pages: DataFrame, weight: dict[str, float], column: str = "html", text: str = "text") -> DataFrame:
    """All rows and columns of ``pages`` with their main text (a column of that name is replaced)."""
    pages = pages.drop(text)
    at = pages.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [main_text(p, weight) for p in part.column(at).to_pylist()]
                yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, text])

    let_workers_import(pages.sparkSession)
    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(text, T.StringType())]))
