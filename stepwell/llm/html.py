"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|math|object|canvas|title|xmp)\b[^>]*+(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^\"'<>]++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z|(?=<))",
    re.S | re.I,
)
_ATTR = re.compile(r"""(?:\s|^)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

# Elements by what they are on a page (fixed names of HTML).
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
BESIDE = frozenset("nav header footer aside form dialog menu fieldset".split())
CONTROLS = frozenset("button select datalist head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
# Blocks of running text, which belong to the element around them; the page stands for html and body.
TEXT = frozenset("html body p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd blockquote pre figure figcaption address table caption thead tbody tfoot tr".split())
ROWS = frozenset("table thead tbody tfoot tr".split())  # these break no line: their cells do
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that need no end tag: the next one of their name, or for a paragraph any block, ends them.
SELF_ENDING = frozenset("p li dt dd h1 h2 h3 h4 h5 h6".split())
# Words in class, id or role that name what is not the article, and words that say nothing after such a one.
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disqus footer gdpr header login masthead menu modal "
    "nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
EMPTY_WORDS = frozenset("area bar block body box button buttons card col column container content element form frame group holder icons inner item items layout link links list main message outer page panel post posts row section site slot text unit wrap wrapper zone".split())

#: Lines in a window, the length of text in a window at which a text surges, and what part of the page's highest surge
#: another one must reach.
WINDOW, SURGE, RELATIVE = 3, 86, 0.5
#: What a character counts inside of a marked article, and in what names or kinds of elements call something else.
MARKED, FAINT = 8.0, 1 / 32


class Line(NamedTuple):
    text: str
    length: int  # text outside of links; a heading's links count
    weight: float = 1.0  # what a character of it counts in the distribution
    element: int = -1  # the enclosing element, 0 is the page
    tag: str = ""  # the innermost block


EMPTY = Line("", 0)


def _named_other(value: str) -> bool:
    """Whether a class, id or role names something else: by its last word, those left out that say nothing after it."""
    for name in value.lower().split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        while len(words) > 1 and words[-1] in EMPTY_WORDS:
            words.pop()
        if words and words[-1] in OTHER_WORDS:
            return True
    return False


def _kind(name: str, attrs: str, in_article: bool) -> str:
    """hidden, beside (what the page calls something else than the article) or empty."""
    if name in ("html", "body", "main"):
        return ""
    if name in CONTROLS:
        return "hidden"
    beside = name in BESIDE and not (name == "header" and in_article)
    for key, value in _ATTR.findall(attrs) if attrs and not attrs.isspace() else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return "hidden"
        if key in ("class", "id", "role") and _named_other(value):
            # the head of an article is its own
            beside = beside or not (in_article and set(re.split(r"[^a-z]+", value)) & {"header"} and not set(re.split(r"[^a-z]+", value)) & (OTHER_WORDS - {"header"}))
    return "beside" if beside else ""


def text_lines(page: str) -> list[Line]:
    """All lines of a page: every tag of a block ends a line, so what lies between two texts leaves empty lines.

    Sibling paragraphs are one empty line apart; the bounds of an element that holds several lines count twice, and those
    of a marked article or of an element beside it as often as no window spans. Lines in an article weigh MARKED, lines
    in what names, classes and roles call something else (BESIDE, OTHER_WORDS) weigh FAINT. Hidden elements and controls
    have no lines. An element that is never closed ends where an article begins; paragraphs and items end each other. The
    element of a line is the innermost one that holds other lines as well, paragraphs, headings, lists and tables aside;
    that of a line beside the article is the outermost one beside it.
    """
    items: list[Line | int] = []  # lines with text, and breaks: -1, or the number of an element that begins or ends
    parents = [0]
    wide: set[int] = set()  # elements whose bounds no window spans
    inner: list[tuple[str, int]] = []  # open elements
    besides: list[int] = []  # those of them beside the article
    depth: Counter[str] = Counter()
    piece: list[str] = []
    linked: list[str] = []
    skip: list[str] = []  # open elements of the hidden one that is being passed over
    article = at = 0
    links = False
    tag = "body"

    def block() -> None:
        if piece:
            text = " ".join(html.unescape("".join(piece)).split())
            if text:
                length = len(text)
                if linked and not (article and not besides) and tag not in HEADINGS:
                    length = max(0, length - len(" ".join(html.unescape("".join(linked)).split())))
                weight = FAINT if besides else MARKED if article else 1.0
                items.append(Line(text, length, weight, besides[0] if besides else inner[-1][1] if inner else 0, tag))
            piece.clear()
            linked.clear()

    def leave() -> None:
        last, number = inner.pop()
        depth[last] -= 1
        if besides and besides[-1] == number:
            besides.pop()
        items.append(number)

    def enter(name: str, beside: bool) -> None:
        number = len(parents)
        parents.append(inner[-1][1] if inner else 0)
        inner.append((name, number))
        depth[name] += 1
        if beside:
            besides.append(number)
        if beside or name in MAIN:
            wide.add(number)
        items.append(number)

    for m in _MARKUP.finditer(page):
        if not skip and m.start() > at:
            piece.append(page[at : m.start()])
            if links:
                linked.append(piece[-1])
        at = m.end()
        if m["cdata"] is not None and not skip:
            piece.append(html.escape(m["cdata"], quote=False))
        if not (name := m["name"]):
            continue
        name, closing, attrs = name.lower(), bool(m["close"]), m["attrs"] or ""
        opening = not closing and name not in VOID and not attrs.endswith("/")
        if skip:
            if opening and name in MAIN and not article and skip[0] not in MAIN and not _kind(name, attrs, False):
                skip.clear()
            else:
                if opening and name == skip[0] and name not in SELF_ENDING:
                    skip.append(name)
                elif name == skip[0]:
                    skip.pop()
                if name not in INLINE:
                    items.append(-1)
                if skip or closing:
                    continue
        kind = _kind(name, attrs, article > 0) if opening else ""
        if kind == "hidden" or kind and name in INLINE:
            block()
            items.append(-1)
            skip.append(name)
            continue
        if name == "a":
            links = not closing
        if name in INLINE:
            continue
        block()
        # a block ends an open paragraph beside the article, an item the one before it
        while not closing and inner and inner[-1][0] in SELF_ENDING and (inner[-1][0] == name or inner[-1][0] not in ("li", "dt", "dd")):
            leave()
        if name in MAIN:
            if opening:
                while besides and not article:  # what was never closed ends here
                    leave()
                article += not kind
                enter(name, bool(kind))
            elif closing and depth[name]:
                while inner[-1][0] != name:
                    leave()
                article = max(0, article - (inner[-1][1] not in besides))
                leave()
        elif opening and (kind or name not in TEXT):
            enter(name, bool(kind))
        elif closing and depth[name] and (name not in TEXT or any(n == name and e in besides for n, e in inner)):
            while inner[-1][0] != name:
                leave()
            leave()
        elif name not in ROWS:
            items.append(-1)
        tag = name if name in TEXT and not closing else inner[-1][0] if inner else "body"
    if not skip:
        piece.append(page[at:])
    block()
    return _laid_out(items, parents, wide)


def _laid_out(items: list[Line | int], parents: list[int], wide: set[int]) -> list[Line]:
    """The lines with the empty ones between them, and with their innermost elements that hold more than one."""
    held = [0] * len(parents)  # each element comes after its parent
    for it in items:
        if not isinstance(it, int):
            held[it.element] += 1
    for e in range(len(parents) - 1, 0, -1):
        held[parents[e]] += held[e]
    lines: list[Line] = []
    breaks = 0
    for it in items:
        if isinstance(it, int):
            breaks += WINDOW + 1 if it in wide else 2 if it > 0 and held[it] > 1 else 1
            continue
        e = it.element
        while e > 0 and held[e] == 1 and e not in wide:
            e = parents[e]
        if lines:
            lines.extend([EMPTY] * min(breaks - 1, WINDOW))  # more would change no window
        lines.append(it._replace(element=e))
        breaks = 0
    return lines


def zones(lengths: np.ndarray) -> list[tuple[int, int, float]]:
    """(surge, dive, largest window) of each run of lines: a window's text rises from nothing, and falls to nothing.

    The surge is the first line with text, the dive comes after the last one before a window without any.
    """
    if not len(lengths):
        return []
    sums = np.convolve(lengths, np.ones(WINDOW))[WINDOW - 1 :]  # of the window that begins at each line
    found: list[tuple[int, int, float]] = []
    surge = last = None
    for i, (n, s) in enumerate(zip(lengths.tolist(), sums.tolist(), strict=True)):
        if n:
            surge, last = i if surge is None else surge, i
        if surge is not None and s == 0:
            found.append((surge, last + 1, float(sums[surge:i].max())))
            surge = None
    if surge is not None:
        found.append((surge, last + 1, float(sums[surge:].max())))
    return found


def _surging(lines: list[Line], found: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """The zones that are the page's text, as (first line, end).

    Zones whose text lies mostly in the same element are judged as one: what stands beside a text parts it into zones,
    but does not make its short ones fall. A text stays if its highest window reaches SURGE, and RELATIVE of the page's
    highest; where none reaches SURGE, that with the most text stays, unless all of it is beside an article that is not
    there and too short for one. Tags only settle what lengths leave open: of a text
    that surges, a zone too short to surge itself stays if it has a heading or the same kind of block, and short lines at
    a zone's ends fall if they stand bare in a box and the zone's text does not.
    """
    groups: dict[int, list[tuple[int, int, float]]] = {}
    for z in found:
        share: Counter[int] = Counter()
        for line in lines[z[0] : z[1]]:
            share[line.element] += line.length
        groups.setdefault(max(share, key=share.__getitem__), []).append(z)
    lengths = {e: np.array([line.length * line.weight for a, b, _ in group for line in lines[a:b] if line.length]) for e, group in groups.items()}
    peaks = {e: max(z[2] for z in zones(n)) for e, n in lengths.items()}
    high = max(peaks.values(), default=0)
    if high >= SURGE:
        texts = [e for e, peak in peaks.items() if peak >= max(SURGE, RELATIVE * high)]
    else:
        texts = sorted(groups, key=lambda e: -float(lengths[e].sum()))[:1]
        # a page of nothing but what stands beside an article has a text only if that would surge in its place
        texts = [e for e in texts if any(line.weight > FAINT or peaks[e] >= SURGE * FAINT for a, b, _ in groups[e] for line in lines[a:b])]
    out: list[tuple[int, int]] = []
    for e in texts:
        kinds = {line.tag for a, b, peak in groups[e] if peak >= SURGE for line in lines[a:b] if line.length}
        for a, b, peak in groups[e]:
            if peak >= SURGE or not kinds or any(line.tag in kinds or line.tag in HEADINGS for line in lines[a:b] if line.length):
                out.append(_trimmed(lines, a, b))
    return sorted(out)


def _trimmed(lines: list[Line], a: int, b: int) -> tuple[int, int]:
    share: Counter[str] = Counter()
    for line in lines[a:b]:
        share[line.tag] += line.length
    if max(share, key=share.__getitem__) in TEXT - {"body", "html"}:
        bare = lambda line: not line.text or line.tag not in TEXT and line.length < SURGE
        while a < b and bare(lines[a]):
            a += 1
        while a < b and bare(lines[b - 1]):
            b -= 1
    return a, b


def main_text(page: str | None) -> str:
    """The article's lines, joined by line breaks.

    The weighted lengths of the page's lines are summed over windows of 3 lines. A zone begins where text surges and ends
    where it dives to nothing. Which zones stay depends on how high their windows rise (see _surging), on every page: a
    mark of an article or a name of something else makes its lines weigh more or less, and neither keeps nor removes
    them. A page without text, or None, gives an empty text; no page is cut off, however long.
    """
    lines = text_lines(page or "")
    found = zones(np.array([line.length * line.weight for line in lines]))
    return "\n".join(line.text for a, b in _surging(lines, found) for line in lines[a:b] if line.text)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, a row for every row.

    A null or empty html gives an empty text; repeated rows come as often as they are, an empty table gives no rows, and
    other columns of the pages, whatever their names, play no part.
    """

    def run(rows: dict[str, list]) -> dict[str, list]:
        texts = [main_text(h) for h in rows["html"]]
        return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return arrow_map(pages.select("page_id", "url", F.col("html").cast("string").alias("html")), run, "page_id long, url string, text string, n_chars long")


def op6_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
