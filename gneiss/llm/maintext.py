"""Main-text extraction by the distribution of text over line blocks."""

from __future__ import annotations

import html
import re
from itertools import groupby
from statistics import median_low

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.textbytes import bounded_batches

#: Elements whose content is no text of the page.
HIDDEN = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "select", "datalist", "head", "title"}
HIDDEN_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in HIDDEN}
#: Elements around the article, not of it.
APART = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "textarea", "fieldset"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that a start tag of the key ends by itself.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_NAMES = (
    r"ads?|adverts?|advertisement|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|nav(?:bar|igation)?|menu|breadcrumbs?|header|masthead|footer|foot|"
    r"sidebar|side|aside|widget|related|recommend(?:ed|ations)?|share|sharing|social|cookies?|consent|gdpr|notice|popup|modal|"
    r"newsletter|subscribe|subscription|signup|login|search|pagination|pager|toolbar|copyright|legal|disclaimer|skip"
)
_BEGIN, _END = r"(?:^|\s|(?<!\bhas)(?<!\bwith)(?<!\bwithout)(?<!\bno)[_-])", r"(?=$|[\s_-])"
#: Names of classes and ids around an article, of readers' comments, and of heads that an article has itself.
NAMED_APART = re.compile(rf"{_BEGIN}(?:{_NAMES}){_END}", re.I)
NAMED_COMMENTS = re.compile(rf"{_BEGIN}(?:comments?|replies|respond|disqus){_END}", re.I)
NAMED_HEAD = re.compile(rf"{_BEGIN}(?:header|masthead){_END}", re.I)
ROLES_APART = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|"
    r"</?([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+(?:[\"'][^>]*)?)(?:>|$)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.S)
SPACE = re.compile(r"\s+")
WINDOW = 3
#: Characters from which on a line counts as text without doubt.
LONG = 80
#: Weight of text inside an article or main element against that of text outside.
MARKED = 4
#: Weight of text inside an element of the article whose name speaks against it.
DOUBTED = 0.8
#: Elements that end at a slash in their start tag; for all others HTML ignores it.
FOREIGN = {"svg", "math"}


#: How an element stands to the text: part of it, apart by its tag or role, apart by its name, or comments by its name.
OF_TEXT, APART_BY_KIND, APART_BY_NAME, COMMENTS = range(4)


def _kind(tag: str, attributes: str, in_article: bool) -> int:
    if tag in APART:
        return APART_BY_KIND
    if tag in ("html", "body", "main", "article"):
        return OF_TEXT
    kind = OF_TEXT
    for name, *values in ATTRIBUTE.findall(attributes) if "=" in attributes else ():
        value, name = "".join(values), name.lower()
        if name == "role" and value.lower() in ROLES_APART or name == "aria-hidden" and value.lower() == "true":
            return APART_BY_KIND
        if name in ("class", "id"):
            if NAMED_COMMENTS.search(value):
                kind = COMMENTS
            elif NAMED_APART.search(NAMED_HEAD.sub("", value) if in_article else value):
                kind = max(kind, APART_BY_NAME)
    hidden = re.search(r"(?:^|\s)hidden(?:\s|=|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes), re.I)
    return APART_BY_KIND if hidden else kind


class Named:
    """An element that is apart by its name: what it holds, and where it stands, tells whether that is believed.

    A wrapper of an article or main element is no menu or sidebar, whatever its
    name; nor is, on a page that has no such element, a wrapper of a heading and
    of more than half of the page's text.  Comments always are comments.  Inside
    the article a name is doubted: the sums over windows of its own lines decide.
    """

    __slots__ = ("outer", "comments", "believed", "mass", "heading", "area", "element", "fate")

    def __init__(self, outer: Named | None, comments: bool, area: int, element: int):
        self.outer, self.comments, self.believed, self.mass, self.heading = outer, comments, True, 0, False
        self.area, self.element = area, element
        self.fate: bool | Named = False  # whether its lines go, or the doubted element they stand or fall with


class Line:
    """A block of text: its words, how much of it is link text, where it stands."""

    __slots__ = ("text", "linked", "named", "area", "heading", "element")

    def __init__(self, text: str, linked: int, named: Named | None, area: int, heading: bool, element: int):
        self.text, self.linked, self.named, self.area, self.heading, self.element = text, linked, named, area, heading, element

    @property
    def plain(self) -> int:
        """Characters that are not link text."""
        return max(len(self.text) - 2 * self.linked, 0)


class Open:
    """The open elements of a page, with counts, so that no tag looks through all of them."""

    def __init__(self):
        self.stack: list[tuple[str, bool, Named | None, int, int, int]] = []  # tag, apart by kind, by name, area, blocks up to here, number
        self.at: dict[str, list[int]] = {}
        self.parents = [0]  # of each element by its number; 0 is the page

    @property
    def top(self) -> tuple[str, bool, Named | None, int, int, int]:
        return self.stack[-1] if self.stack else ("", False, None, 0, 0, 0)

    def push(self, tag: str, apart: bool, named: Named | None, area: int) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        number = self.top[5]
        if tag in BLOCKS and tag not in ("html", "body"):
            self.parents.append(number)
            number = len(self.parents) - 1
        self.stack.append((tag, apart, named, area, self.top[4] + (tag in BLOCKS), number))

    def pop(self) -> None:
        self.at[self.stack.pop()[0]].pop()

    def close(self, tag: str) -> None:
        """Ends the last element of the tag; an inline one only where no block is open in it."""
        if not self.at.get(tag):
            return
        depth = self.at[tag][-1]
        if tag in BLOCKS or self.top[4] == self.stack[depth][4]:
            while len(self.stack) > depth:
                self.pop()


def lines_of(page: str) -> list[Line]:
    """The page as lines of text, one a block, with markup stripped.

    Lines that are apart by their tag, their role or a believed name are left
    out; those of a doubted one have it as their name's ``fate``.  ``area`` numbers the article (or main) element that a line is in, 0
    for none.  A header is apart only outside an article.  Time is linear in
    the page, however its elements are nested or left open.
    """
    out: list[Line] = []
    names: list[Named] = []
    open_, parts, endless = Open(), [], set()
    areas, at, linked, heading = 0, 0, 0, False

    def flush() -> None:
        nonlocal linked, heading
        _, apart, named, area, _, element = open_.top
        text = "" if apart else SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            out.append(Line(text, linked, named, area, heading, element))
        parts.clear()
        linked, heading = 0, False

    end = len(page)
    while at < end:
        found = TOKEN.search(page, at)
        stop = found.start() if found else end
        if stop > at:
            parts.append(page[at:stop])
            linked += len(page[at:stop].strip()) if open_.at.get("a") else 0
            heading = heading or open_.top[0] in ("h1", "h2", "h3", "h4", "h5", "h6")
        if not found:
            break
        at = found.end()
        tag = (found[1] or "").lower()
        if not tag:
            if found[0].startswith("<![CDATA["):
                parts.append(html.escape(found[0][9:].removesuffix("]]>"), quote=False))
            continue
        if tag in BLOCKS:
            flush()
        if found[0].startswith("</"):
            open_.close(tag)
            continue
        closed = tag in FOREIGN and found[0].endswith("/>")
        if tag in HIDDEN and not closed:
            close = None if tag in endless else HIDDEN_END[tag].search(page, at)
            if not close:
                endless.add(tag)
            if close or tag not in ("head", "title"):
                at = close.end() if close else end
            continue
        if tag in BLOCKS and open_.top[0] == "p":
            open_.pop()
        while open_.top[0] in CLOSED_BY.get(tag, ()):
            open_.pop()
        if tag == "br":
            parts.append(" ")
        if tag in VOID or closed:
            continue
        if tag == "a":
            open_.close("a")
            tag = "a" if re.search(r"(?:^|\s)href\s*=", found[2] or "", re.I) else "a name"
        _, apart, named, area, _, element = open_.top
        if tag in ("article", "main") and not apart and not area:
            wrapper = named
            while wrapper and not wrapper.comments and wrapper.believed:
                wrapper.believed, wrapper = False, wrapper.outer
            if not wrapper or not wrapper.believed:
                areas += 1
                area = areas
        if not apart:
            kind = APART_BY_KIND if tag == "header" and not area else _kind(tag, found[2] or "", area > 0)
            apart = kind == APART_BY_KIND
            if kind in (APART_BY_NAME, COMMENTS):
                named = Named(named, kind == COMMENTS, area, element)
                names.append(named)
        open_.push(tag, apart, named, area)
    flush()
    for line in out:
        if line.named:
            line.named.mass += line.plain
            line.named.heading = line.named.heading or line.heading
    for named in reversed(names):  # inner ones stand behind outer ones
        if named.outer:
            named.outer.mass += named.mass
            named.outer.heading = named.outer.heading or named.heading
    whole = sum(line.plain for line in out)
    inside = [] if areas else _inside_most(out, open_.parents, whole)
    for named in names:
        wraps = not areas and named.heading and 2 * named.mass > whole
        believed = named.comments or named.believed and not wraps
        outer = named.outer.fate if named.outer else False
        if outer is True or believed and (named.comments or not (named.area if areas else inside[named.element])):
            named.fate = True
        else:
            named.fate = outer or believed and named
    return [line for line in out if not (line.named and line.named.fate is True)]


def _inside_most(lines: list[Line], parents: list[int], whole: int) -> list[bool]:
    """Of each element whether it is in, or is, the innermost one with more than half of the page's text."""
    mass = [0] * len(parents)
    for line in lines:
        mass[line.element] += line.plain
    for element in range(len(parents) - 1, 0, -1):
        mass[parents[element]] += mass[element]
    most = max((e for e in range(1, len(parents)) if 2 * mass[e] > whole), default=-1)  # such elements are nested
    inside = [False] * len(parents)
    for element in range(1, len(parents)):
        inside[element] = element == most or inside[parents[element]]
    return inside


def _trusted(lines: list[Line], window: int) -> list[Line]:
    """The lines without those of doubted elements in which no window has DOUBTED times LONG characters of text."""
    out: list[Line] = []
    for fate, run in groupby(lines, lambda x: x.named.fate if x.named else False):
        run = list(run)
        if not fate or DOUBTED * max(sum(x.plain for x in run[i : i + window]) for i in range(len(run))) >= LONG:
            out += run
    return out


def _stretches(lines: list[Line], window: int) -> list[Line]:
    """The lines between the points where sums over sliding windows surge and dive.

    A line's mass counts the characters that are not link text, MARKED times
    where it is inside an article or main element; windows end at the edges of
    such elements.  Text dives where a whole window has next to none, so fewer
    lines of links than a window end nothing, and it resumes behind: every
    stretch in which a window surges to a typical line is kept.  The typical
    line is the median of those with text, LONG characters at most, so one long
    block raises no bar.  Headings and lines inside a marked element hold a
    stretch together; other lines of links at either end of one go.  Where all
    text is links nothing tells lines apart: the marked ones are kept, or all.
    """
    plain = [x.plain for x in lines]
    if not any(plain):
        return [x for x in lines if x.area] or lines
    mass = [m * MARKED if x.area else m for x, m in zip(lines, plain, strict=True)]
    surge = median_low([min(m, LONG) * (MARKED if x.area else 1) for x, m in zip(lines, plain, strict=True) if m])
    floor = max(min(surge, LONG) / 20, 1)
    hold = [max(m, floor) if x.heading or x.area else m for x, m in zip(lines, mass, strict=True)]
    dived = [False] * len(lines)
    out: list[Line] = []
    to = 0
    for _, same_area in groupby(x.area for x in lines):
        at, to = to, to + len(list(same_area))
        for i in range(at, to - window + 1):
            if sum(hold[i : i + window]) < floor:
                dived[i : i + window] = [True] * window
        for out_of_text, run in groupby(dived[at:to]):
            first, at = at, at + len(list(run))
            last = at - 1
            if out_of_text or max(sum(mass[i : min(i + window, at)]) for i in range(first, at)) < surge:
                continue
            while not mass[first] and not lines[first].heading and not lines[first].area:
                first += 1
            while not mass[last] and not lines[last].area:
                last -= 1
            out += lines[first : last + 1]
    return out


def main_text(page: str | None, window: int = WINDOW) -> str:
    """The article of a page: its blocks in page order, joined by two line feeds.

    Lines inside menus, headers, footers, sidebars, notices, adverts, forms and
    reader comments are left out; inside the article a name alone takes no block
    away that has text enough.  Surge and dive are sought over all other
    lines of every page; article and main elements are a signal for them, as
    their lines weigh more and their edges end windows.  Several such elements
    are all kept, and so is text outside them, where it surges.
    """
    return "\n\n".join(x.text for x in _stretches(_trusted(lines_of(page or ""), window), window))


def _extract(batches):
    for batch in batches:
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"]
        )


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url_col, text, n_chars)`` of every row, from the whole html.

    A page is worked on by itself: tags, comments, scripts and styles are
    stripped, every block gives a line, and the lines between the points where
    text over a sliding window surges and dives are kept, on every page.  Character references
    are decoded and white space inside a block is one space.  Null, empty or
    text-free html gives an empty text.  Ids may be null or repeat; other
    columns play no part.  There is no shuffle.
    """
    bounded_batches(pages.sparkSession)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = rows.mapInArrow(_extract, f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
