"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a line of text where they open or close.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead title tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is never main text.
DROPPED = frozenset(
    "nav footer aside script style noscript template title textarea select option button label fieldset "
    "iframe object svg canvas menu dialog head input datalist".split())
#: Left out by name, unless they hold most of the page: some servers wrap each page in one form.
FORMS = frozenset(("form",))
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Words in a class or id that name what isn't main text.
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer masthead topbar cookie cookies consent gdpr banner notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription signup comment comments commentlist respond disqus "
    "replies related recommended recommendations share sharing social login search pagination pager widget toolbar "
    "skip copyright".split())
#: A name with one of these says nothing of the element's own kind.
LAYOUT_WORDS = frozenset("has no not with without".split())
CONTENT = frozenset(("article", "main"))
#: An article named so is what a reader wrote, or a link to another one.
OTHER_ARTICLES = frozenset(("comment", "comments", "reply", "related", "teaser"))
#: An element of these kinds ends an open element of the same kind.
SELF_CLOSING = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SIGMA = 1.0
APART, SHORT = 4.0, 8.0
#: Blocks of text and lists: their lines belong to the container around them.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote center address figcaption caption table thead tbody tfoot tr td th summary hgroup".split())
#: A heading that says just this opens what readers wrote, or what isn't the article.
ASIDE_HEADING = re.compile(
    r"(?:comments?|responses?|repl(?:y|ies)|kommentare?|commentaires?|comentarios?)\s*(?:\(\d+\))?:?|\d+\s+(?:comments?|responses?|replies|kommentare?|commentaires?|comentarios?)\b.{0,80}|"
    r"(?:leave|post|write) a (?:comment|reply)|related (?:articles|posts|stories)|advertisement|anzeige|publicit[eé]|publicidad|you may also like", re.I)
RIGHTS = re.compile(r"(?:©|\(c\)|copyright\s*(?:©|\(c\)|\d{4}))", re.I)
#: What evidence does to the ratio of a line: a name made of dropped words alone (or a form), a name that contains one (or words as of a notice of rights, or what follows a heading as of comments), an article or main element.
NAMED, HINTED, IN_ARTICLE = 0.05, 0.4, 4.0
#: A named element that holds more than this share of the page's text outside links is named amiss.
MOST = 0.75


def names_of(value: str) -> list[set[str]]:
    """The words of each name in a class or id, without names that speak of the layout."""
    names = [set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower())) - {""} for x in value.split()]
    return [x for x in names if LAYOUT_WORDS.isdisjoint(x)]


def marked(names: list[set[str]]) -> int:
    """2 if a name is made of dropped words alone, 1 if one only contains such a word, else 0."""
    return max((2 if DROPPED_WORDS.issuperset(x) else 1 for x in names if not DROPPED_WORDS.isdisjoint(x)), default=0)


class Line(NamedTuple):
    text: str
    tags: int
    link: int  # characters in links
    content: bool  # within article or main
    mark: int  # number of the innermost marked element around it, or -1
    place: int  # number of its container
    heading: bool
    aside: bool  # after a heading as of comments, in its container


class Open(NamedTuple):
    """An open element."""

    tag: str
    dropped: bool
    content: bool
    mark: int
    place: int
    aside: int  # number of the mark of an element within a line that is named as no main text, or -1


class Lines(HTMLParser):
    """The lines of a page from parser events, its containers (parent, tag, class) and its marked elements (strength, the marked element around it).

    Text belongs to the element that it stands in: what stands in a dropped one is never collected, wherever that one opens and closes.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[Open] = [Open("", False, False, -1, 0, -1)]
        self.places: list[tuple[int, str, str]] = [(-1, "", "")]
        self.after: list[bool] = [False]  # of each container: does what comes now follow a heading as of comments?
        self.marks: list[tuple[int, int]] = []
        self.open: Counter[str] = Counter()
        self.parts: list[tuple[str, bool, int]] = []  # text, in a link, the mark of the aside it stands in
        self.tags = self.links = 0

    def parse_marked_section(self, i, report=1):
        """Sections such as <![x[ are comments to HTML, whatever their name."""
        at = self.rawdata.find(">", i)
        return at + 1 if at >= 0 else -1

    def flush(self) -> None:
        alone = not any(x.strip() and a < 0 for x, _, a in self.parts)  # nothing but asides: then they are the line
        parts = [(x, link) for x, link, a in self.parts if alone or a < 0]
        mark = max((a for x, _, a in self.parts if x.strip()), default=-1) if alone else -1
        self.parts.clear()
        text = " ".join("".join(x for x, _ in parts).split())
        if not text:
            return
        at = self.stack[-1]
        heading = any(self.open[h] for h in HEADING)
        if heading and not at.content and ASIDE_HEADING.fullmatch(text) and self.places[at.place][1] not in ("", "html", "body"):
            self.places[at.place] = (*self.places[at.place][:2], f"{self.places[at.place][2]} \0")  # no longer like its neighbours
            self.after[at.place] = True
        link = min(sum(len(x) for x, link in parts if link), len(text))
        self.lines.append(Line(text, self.tags, link, at.content, mark if mark >= 0 else at.mark, at.place, heading, self.after[at.place]))
        self.tags = 0

    def handle_starttag(self, tag, attrs):
        around = self.stack[-1]
        if around.dropped and tag != "body":
            if tag not in VOID:
                self._push(Open(tag, True, around.content, around.mark, around.place, around.aside))
            return
        self.tags += 1
        if tag == "br":
            self.parts.append(("\n", False, -1))
        if tag in BLOCK:
            self.flush()
        if tag in VOID:
            return
        closes = SELF_CLOSING.get(tag, ("p",) if tag in BLOCK else ())
        while closes and self.stack[-1].tag in (*closes, "b", "i", "em", "strong", "span", "a", "u") and any(x.tag in closes for x in self.stack[-4:]):
            self._pop()
        _, dropped, content, mark, place, aside = self.stack[-1]
        named: list[set[str]] = []
        look = ""
        for key, value in attrs:
            if value and key in ("class", "id"):
                named += names_of(value)
                look += value if key == "class" else ""
            elif value and key == "role":
                dropped |= value.strip().lower() in DROPPED_ROLES
        dropped |= tag in DROPPED or (tag == "header" and not content)
        if tag == "body":
            dropped = False
        other = tag == "article" and any(OTHER_ARTICLES.issuperset(x) for x in named if x)
        strength = 2 if other or tag in FORMS else marked(named)
        if tag in ("html", "body", "article", "main") and not other:
            mark = -1
        elif strength:
            self.marks.append((strength, mark))
            if strength == 2 and tag not in BLOCK:
                aside = len(self.marks) - 1
            else:
                mark = len(self.marks) - 1
        if tag in BLOCK and tag not in LEAVES:
            self.places.append((place, tag, look))
            self.after.append(self.after[place])
            place = len(self.places) - 1
        self._push(Open(tag, dropped, content or tag in CONTENT and not other, mark, place, aside))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if (tag in ("svg", "math") or self.open["svg"] or self.open["math"]) and tag not in VOID:  # only there does the slash close
            self._pop()

    def _push(self, x: Open) -> None:
        self.stack.append(x)
        self.open[x.tag] += 1
        self.links += x.tag == "a"

    def _pop(self) -> str:
        tag = self.stack.pop().tag
        self.open[tag] -= 1
        self.links -= tag == "a"
        return tag

    def handle_endtag(self, tag):
        dropped = self.stack[-1].dropped
        if not dropped:
            self.tags += 1
            if tag in BLOCK:
                self.flush()
        if self.open[tag]:
            while self._pop() != tag:
                pass

    def handle_data(self, data):
        at = self.stack[-1]
        if not at.dropped:
            self.parts.append((data, bool(self.links), at.aside))


def evidence(parser: Lines) -> np.ndarray:
    """What the names around each line do to its ratio. A named element that holds most of the page's text is named amiss and says nothing;
    and where all text stands in named ones, nor does the fullest of them."""
    lines, marks = parser.lines, parser.marks
    prose = np.zeros(len(marks) + 1)
    for x in lines:
        prose[x.mark] += len(x.text) - x.link
    prose[-1] = 0
    for m in range(len(marks) - 1, -1, -1):  # inner ones have the larger number
        if marks[m][1] >= 0:
            prose[marks[m][1]] += prose[m]
    most = MOST * sum(len(x.text) - x.link for x in lines)

    def strengths(spared: int) -> list[int]:
        said = [0] * (len(marks) + 1)
        for m, (strength, around) in enumerate(marks):
            said[m] = max(said[around] if around >= 0 else 0, 0 if prose[m] > most or m == spared else strength)
        return said

    said = strengths(-1)
    if marks and lines and all(said[x.mark] == 2 if x.mark >= 0 else False for x in lines):
        said = strengths(int(prose[:-1].argmax()))
    factor = np.array([1.0, HINTED, NAMED])[[said[x.mark] if x.mark >= 0 else 0 for x in lines]]
    hint = np.array([not x.content and (x.aside or bool(RIGHTS.match(x.text))) for x in lines], bool)
    return np.minimum(factor, np.where(hint, HINTED, 1.0))


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing, the ends repeated."""
    r = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, r, mode="edge"), kernel / kernel.sum(), "valid")


def main_text(html: str | None) -> str:
    """The main text, its blocks joined by one line break; empty if there is none.

    Text in elements that never hold main text (nav, footer, button, script) doesn't count. Each line has its ratio of text
    outside links to tags, smoothed along the page. Names, roles and headings are evidence, no verdicts: they lower the ratio of
    what is named as an advert or a sidebar, of what follows a heading as of comments and of a notice of rights, as far as it
    isn't most of the page; article and main elements raise it. The lines whose ratio reaches the threshold between its two clusters,
    and that aren't made of links, are cores; their containers, and what lies between them, are the content regions (see regions).
    """
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    keep = chosen(parser, threshold)
    return "\n".join(x.text for x, k in zip(lines, keep, strict=True) if k)


def chosen(parser: Lines, cut: Callable[[np.ndarray], float]) -> np.ndarray:
    """Which of the parser's lines are main text; cut gives the ratio that parts the clusters."""
    lines = parser.lines
    chars = np.array([len(x.text) for x in lines], float)
    plain = chars - [x.link for x in lines]
    content = np.array([x.content for x in lines])
    said = evidence(parser)
    prior = said * np.where(content, IN_ARTICLE, 1.0)
    own = plain / np.maximum(1, [x.tags for x in lines])
    ratio = smooth(own) * prior
    least = cut(ratio)
    dense = ratio >= least
    links = 2 * plain <= chars
    core = dense & (own * prior >= 0.5 * least) & ~links  # smoothing also lifts what stands beside a long line
    core = core if core.any() else dense & ~links
    if not core.any():  # links alone: the densest of them are all there is
        core = dense
    weak = said < 1
    keep = regions(lines, core, links, parser.places)
    keep &= ~weak | (dense & ~links)
    for k in np.flatnonzero(keep[:-1]).tolist():  # a list of links under a heading of the article is its own
        n = k + 1
        while lines[k].heading and not weak[k] and n < len(lines) and links[n] and not weak[n] and not lines[n].heading and lines[n].content == lines[k].content and lines[n].place == lines[k].place:
            keep[n] = True
            n += 1
    return keep


def regions(lines: list[Line], core: np.ndarray, links: np.ndarray, places: list[tuple[int, str, str]]) -> np.ndarray:
    """Which lines belong to the content regions around the cores.

    A region takes all lines of a core's container that aren't made of links, the like containers beside it where there are three or
    more, a main heading right before it, and whatever lies between two of its lines within one element (or lines of links
    between lines of one container).
    """
    at = np.array([x.place for x in lines])
    # containers are numbered in the order in which they open, so those within one follow it without a gap
    last = np.arange(len(places))
    for p in range(len(places) - 1, 0, -1):
        last[places[p][0]] = max(last[places[p][0]], last[p])
    within = lambda p, q: (p <= q) & (q <= last[p])
    like = Counter(places[p] for p in np.unique(at[core]).tolist())
    counted = set(at[core].tolist())
    alike = {places[p] for p in counted if like[places[p]] >= 3}
    member = np.array([p in counted or places[p] in alike for p in at.tolist()])
    keep = (member & ~links) | (core & member)
    held = np.flatnonzero(keep)
    for a, b in zip(held[:-1].tolist(), held[1:].tolist(), strict=True):
        if b - a > 1:
            shared = int(at[b])
            while not within(shared, at[a]):  # climbs what opened since line a, so each container once
                shared = places[shared][0]
            between = np.arange(a + 1, b)
            if places[shared][1] not in ("", "html", "body"):
                inside = between[within(shared, at[between])]
                if not links[inside].all() or at[a] == at[b]:
                    keep[inside] = True
            elif at[a] == at[b]:
                keep[between[at[between] == at[a]]] = True
    if len(held) and held[0] > 0 and lines[held[0] - 1].heading and not links[held[0] - 1]:
        keep[held[0] - 1] = True
    return keep


def threshold(ratio: np.ndarray) -> float:
    """Two clusters on the line by 2-means; what parts them: their midpoint, but no more than a third of the upper mean, so that the short lines of an article stay.

    Where the largest ratio is under APART times the least (and SHORT more) there is one cluster, and its least ratio is returned.
    """
    low, high = float(ratio.min()), float(ratio.max())
    if high < APART * low + SHORT:
        return low
    for _ in range(20):
        mid = (low + high) / 2
        a, b = ratio[ratio < mid], ratio[ratio >= mid]
        new = (a.mean() if len(a) else low, b.mean() if len(b) else high)
        if new == (low, high):
            break
        low, high = new
    return min((low + high) / 2, high / 3)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns of each page, text (empty if there is none) and n_chars (its code points).

    One row per input row: a null html counts as empty, repeated rows stay, an empty table gives no rows,
    pages of any length are read whole, and columns not kept are ignored whatever their names.
    """
    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")
    html = "__html"

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[*keep, "text", "n_chars"])

    return pages.select(*keep, F.col(html_col).alias(html)).mapInArrow(run, schema)
