"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped: each block element gives a line. Parts that by their element or by a strong class word are no article (menus, headers, footers,
sidebars, adverts, forms, comments) give nothing. Lines that are mostly links, and lines under a weak class word (header, alert, share, ...), count
nothing; nor do those under names that only hold such a word (ad-hoc), but their prose stays. The lengths of what counts are summed over sliding windows of lines. Where the sum surges above a threshold a region begins; where it dives
to nothing the region ends; text between the two, from a heading that leads to it on, is kept in regions whose highest sum comes near the highest of the page. Within a region prose
under a weak class word stays, short lines under one go.

An article or main element is a tie break, no verdict: in a region most of whose text it holds, lines before its first and after its last go, and
where such regions hold most of the page's text, the others go.

Cases: null or empty html gives an empty text; pages are taken whole, whatever their length; an element that is never closed hides nothing, or no
more than what comes before an article; rows that repeat get equal results; an empty table gives no rows; columns beyond page_id, url and html
are ignored.
"""

import html as entities
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

#: Lines in a window, the share of the page's highest sum that a region needs, and the sum at which one begins (SHARE of the highest sum if that is less).
WINDOW, SHARE, SURGE = 3, 0.25, 86
#: Characters from which a line under a weak class word is prose.
PROSE = 40
#: Words of a class, id or role that name what is no article, wherever it stands, and those that do so only where little text stands under them (fixed values).
STRONG = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer gdpr masthead menu menubar modal nav navbar navigation newsletter paywall popup replies respond sidebar skyscraper sponsored".split()
)
WEAK = frozenset(
    "alert banner complementary contentinfo dialog disclaimer header notice notification notifications promo promoted promotion recommended related reply search "
    "share sharing signup skip social sponsor subscribe subscription toc toolbar widget widgets".split()
)
#: Words that may stand beside those without changing what they name, and words for containers, which don't say what a paragraph is.
NEUTRAL = frozenset("area bar block body bottom box btn button class col column container content d desktop div el first global group header holder id inner item js l label last layout left link links list m main mobile module outer page panel primary right row secondary section site slot sm spot text title top unit w wrap wrapper xs".split())
CONTAINERS = frozenset("breadcrumb breadcrumbs footer masthead menu menubar modal nav navbar navigation popup replies respond sidebar".split())
RAW = frozenset("script style textarea title noscript template iframe head".split())
ASIDE = frozenset("nav footer aside form menu dialog button select fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^'">]|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


class Line(NamedTuple):
    text: str
    article: bool
    #: Characters in links.
    links: int
    #: Whether it stands under a weak class word, but for headings.
    weak: bool
    heading: bool


def _evidence(attributes: str, element: str = "div") -> int:
    """2 where attributes say that the element is no article, 1 where they say so weakly, else 0.

    A name tells of the element if each of its words is one of structure: ``ad-slot`` does, ``ad-hoc`` and ``menu-of-the-day`` only weigh against it, and say nothing
    of a paragraph.
    """
    if re.search(r"\bhidden\b(?!\s*=)|display\s*:\s*none", re.sub(r'"[^"]*"(?<!none")', "", attributes)):
        return 2
    found = 0
    for value in NAMES.findall(attributes):
        for name in value.strip("\"'").split():
            words = {w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()) if w}
            strong = words & STRONG
            if strong and words <= STRONG | WEAK | NEUTRAL and not (element == "p" and strong <= CONTAINERS):
                return 2
            found |= bool(strong and element != "p") or not WEAK.isdisjoint(words)
    return int(found)


def lines_of(page: str) -> list[Line]:
    """The page's lines in order; a hidden part leaves an empty line."""
    lines: list[Line] = []
    text: list[str] = []
    links = article = depth = link = weak_depth = 0
    hidden, weak, heading, marked = "", "", False, False
    at, low = 0, page.lower()
    last_close: dict[str, int] = {}

    def end() -> None:
        nonlocal links
        joined = " ".join(entities.unescape("".join(text)).split())
        if joined:
            lines.append(Line(joined, article > 0, 0 if heading else links, bool(weak) and not heading, heading))
        text.clear()
        links = 0

    def closes_after(name: str, here: int) -> bool:
        if name not in last_close:
            last_close[name] = low.rfind("</" + name)
        return last_close[name] > here

    while at < len(page):
        m = TOKEN.search(page, at)
        if not hidden and (piece := page[at : m.start() if m else len(page)]):
            text.append(piece)
            links += len(piece) if link else 0
        if not m:
            break
        at = m.end()
        close, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if hidden:
            if not close and not marked and name in ("article", "main", "h1") and not _evidence(attributes):
                hidden = ""  # the hidden element was never closed
            else:
                if name == hidden:
                    depth += -1 if close else 1 - attributes.endswith("/")
                    hidden = hidden if depth else ""
                continue
        if not close and name in RAW and name != "head":
            stop = low.find("</" + name, at)
            if stop >= 0:
                at = low.find(">", stop) + 1 or len(page)
            elif name in ("script", "style"):
                at = len(page)
            continue
        if name in ("br", "hr", "wbr"):
            text.append(" " if name == "br" else "")
            if name == "hr":
                end()
            continue
        evidence = 0 if close or name in ("html", "body") else _evidence(attributes, name)
        if name in INLINE and not (name == "span" and evidence == 2):
            if name == "a":
                link = 0 if close else 1
            continue
        end()
        if name == weak:
            weak_depth += -1 if close else 1 - attributes.endswith("/")
            weak = weak if weak_depth else ""
        if name in HEADINGS:
            heading = not close
        if close:
            if name in ("article", "main"):
                article = max(0, article - 1)
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if (name in ASIDE or (name == "header" and not article) or name == "head" or evidence == 2) and closes_after(name, at):
            hidden, depth = name, 1
            lines.append(Line("", article > 0, 0, False, False))
            continue
        if evidence == 1 and not weak and closes_after(name, at):
            weak, weak_depth = name, 1
        if name in ("article", "main"):
            article += 1
            marked = True
    end()
    return lines


def line_sizes(lines: list[Line]) -> list[int]:
    """What each line counts: its length, but nothing for one that is mostly links or stands under a weak class word, unless these words leave little of the page."""
    every = [0 if 2 * x.links > len(x.text) else len(x.text) for x in lines]
    sizes = [0 if x.weak else n for x, n in zip(lines, every, strict=True)]
    return sizes if sum(sizes) >= SHARE * sum(every) else every


def regions_of(sizes: list[int], window: int = WINDOW, share: float = SHARE, surge: int = SURGE) -> list[tuple[int, int]]:
    """(first, last + 1) of the lines between each surge and the dive after it, in regions whose highest sum of a window is a share of the page's highest."""
    n = len(sizes)
    sums = [sum(sizes[i : i + window]) for i in range(n)]
    most = max(sums, default=0)
    least, found, i = min(surge, share * most), [], 0
    while i < n:
        if sizes[i] and sums[i] >= least:
            first = i
            while i < n and sums[i]:
                i += 1
            if max(sums[first:i]) >= share * most:
                last = max(j for j in range(first, i) if sizes[j])
                found.append((first, last + 1))
        i += 1
    return found


def _joined(lines: list[Line], regions: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Regions between which an article element holds all lines, and nothing hidden lies, are one: what counted nothing there, as a list of links does, is part of
    the article on both its sides."""
    out: list[tuple[int, int]] = []
    for a, b in regions:
        if out and all(x.text and x.article for x in lines[out[-1][1] : a]):
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def main_text(page: str | None, window: int = WINDOW, share: float = SHARE, surge: int = SURGE) -> str:
    lines = lines_of(page or "")
    sizes = line_sizes(lines)
    regions = regions_of(sizes, window, share, surge)
    own = lambda a, b: [j for j in range(a, b) if lines[j].article and sizes[j]]
    text = lambda js: sum(sizes[j] for j in js)
    for k, (a, b) in enumerate(regions):
        # a region takes the headings that lead to it over short lines
        lead = a
        while lead and sizes[lead - 1]:
            lead -= 1
        regions[k] = (min((j for j in range(lead, a) if lines[j].heading), default=a), b)
    regions = _joined(lines, regions)
    held = []
    for a, b in regions:
        inside = own(a, b)
        if 2 * text(inside) > text(range(a, b)):
            a, b = inside[0], inside[-1] + 1
            # prose under a weak word at an end of the element
            while b < len(lines) and lines[b].article and lines[b].weak and len(lines[b].text) >= PROSE:
                b += 1
            while a and lines[a - 1].article and lines[a - 1].weak and len(lines[a - 1].text) >= PROSE:
                a -= 1
            held.append((a, b))
    if 2 * sum(text(range(a, b)) for a, b in held) > sum(text(range(a, b)) for a, b in regions):
        regions = held
    return "\n".join(x.text for a, b in regions for j, x in enumerate(lines[a:b], a) if x.text and (sizes[j] or not x.weak or len(x.text) >= PROSE > 2 * x.links))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page; columns of other names are ignored."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
