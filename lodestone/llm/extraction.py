"""Operator 9: main text of HTML by line-block distribution.

Markup is stripped into lines, one for each block of text, with an empty line where a container outside articles begins or ends. A line
weighs its length outside anchors; in an article or main element all of its length, `ARTICLE` times; in a container that is
never article text (menus, headers, footers, sidebars, notices, adverts, forms, comments; by element or by class, id or role)
nothing. Weights are summed over sliding windows of lines around each line. A surge is where a window's sum rises from nothing, a dive is where it falls to
nothing again, and the lines between are a region; no window reaches across an article's edge. A region stays if its highest sum is at least `NEAR` of the page's highest,
as long as that is an article's: so a teaser beside an article goes, and so does an article that is a teaser beside the page's
real text. Where the highest sum is no article's nothing tells short text from main text, and every region stays; only
lines of nothing but links, away from other text, go.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.shared import schema_with

#: Lines in a window, how much more a character weighs within articles, and the share of the highest sum that a region needs beside an article.
WINDOW, ARTICLE, NEAR = 3, 8, 0.25
#: Fixed values of HTML: elements by their role in a page.
RAW = "script style noscript template svg math iframe object canvas textarea select datalist xmp head title"
ASIDE = "nav header footer aside form menu dialog button fieldset"
BLOCK = "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul"
VOID = "area base br col embed hr img input link meta param source track wbr"
#: Words of which a name in class, id or role consists that says one of the roles that aren't article text.
OTHER = {
    "menu": "menu menus nav navbar navigation breadcrumb breadcrumbs pagination toolbar", "header": "header masthead", "footer": "footer copyright contentinfo",
    "sidebar": "sidebar side aside complementary related share sharing social widget", "notice": "notice notices alert banner cookie cookies consent gdpr modal popup",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion", "form": "form login newsletter search signup subscribe", "comments": "comment comments replies respond",
}
#: Elements that hold a page's text, whose names tell of its layout or state.
WHOLE = "html body main article"
_RAW, _ASIDE, _BLOCK, _VOID, _WHOLE = (frozenset(x.split()) for x in (RAW, ASIDE, BLOCK, VOID, WHOLE))
_OTHER = frozenset(w for words in OTHER.values() for w in words.split())

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Elements that a following one of the same kind, or their container's end, closes.
_SELF = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6".split())

Line = tuple[str, int, bool, int]


def _other(attributes: str) -> bool:
    """Whether a whole name is of such words: cookie-notice is, no-sidebar and comments-open aren't."""
    for _, a, b, c in _NAMED.findall(attributes):
        for name in (a or b or c).split():
            words = _WORD.findall(_CAMEL.sub(" ", name).lower())
            if words and _OTHER.issuperset(words):
                return True
    return False


def parts(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', text, ''), ('open', name, attributes) and ('close', name, '') in order, without comments, declarations and the contents of raw elements.

    Every character is looked at a bounded number of times, however broken the page is: what a search for a quote or a `>` that
    isn't there has found out is kept.
    """
    at, n, last = 0, len(page), page.rfind(">")
    missing: set[str] = set()  # quotes that don't come again

    def tag_end(i: int) -> int:
        """Where a tag's > is; one in quotes doesn't count if the quotes are closed."""
        while True:
            c = _STOP.search(page, i)
            if c is None:
                return -1
            if c[0] == ">":
                return c.start()
            i = c.end()
            if c[0] not in missing:
                close = page.find(c[0], i)
                if close < 0:
                    missing.add(c[0])
                else:
                    i = close + 1

    while at < n:
        start = page.find("<", at)
        if start != at:
            yield "text", page[at : start if start >= 0 else n], ""
            if start < 0:
                return
            at = start
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            yield "text", html.escape(page[at + 9 : n if end < 0 else end], quote=False), ""
            at = n if end < 0 else end + 3
            continue
        if at < last and page[at + 1] in "!?":
            at = page.find(">", at) + 1
            continue
        name = _NAME.match(page, at + 1) if at < last else None
        end = -1
        if name is not None:
            end = tag_end(name.end())
            if end < 0:  # quotes that never close: the next > is the end
                end = page.find(">", name.end())
        if end < 0:
            yield "text", "<", ""
            at += 1
            continue
        own, closing, attributes = name[1].lower(), page[at + 1] == "/", page[name.end() : end]
        at = end + 1
        if closing:
            yield "close", own, ""
            continue
        if own in _RAW and own != "head":  # up to its own end tag all is its own; head's parts are skipped one by one, since it may have no end tag
            if not attributes.endswith("/"):
                found = re.compile(rf"</{re.escape(own)}\s*[^>]*>", re.I).search(page, at) if at < last else None
                at = n if found is None else found.end()
            if own in ("select", "textarea"):
                yield "text", " ", ""
            continue
        yield "open", own, attributes


def strip(page: str) -> list[Line]:
    """Lines of (text, length of text outside anchors, whether it is never article text, number of the outermost article or 0); ('', 0, False, 0) where a container outside articles begins or ends."""
    out: list[Line] = []
    text: list[str] = []
    stack: list[tuple[str, bool]] = []  # open containers, and whether they are never article text
    opened: Counter[str] = Counter()  # how many of each name are on the stack
    article: list[int] = []
    free = hidden = anchors = articles = inner = 0  # free: characters outside anchors; inner: open article elements

    def flush() -> None:
        nonlocal free
        if line := " ".join(html.unescape("".join(text)).split()):
            out.append((line, free, hidden > 0, article[0] if article else 0))
        text.clear()
        free = 0

    def pop() -> str:
        nonlocal hidden, inner
        name, was = stack.pop()
        opened[name] -= 1
        hidden -= was
        if name in ("article", "main"):
            article.pop()
            inner -= name == "article"
        return name

    for kind, name, attributes in parts(page):
        if kind == "text":
            text.append(name)
            if not anchors:
                free += len(name.strip())
            continue
        if name == "a":
            anchors = int(kind == "open")
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in _VOID and name != "hr":
            continue
        # an article in an article may be a reader's comment; others' names tell of layout
        other = kind == "open" and (name in _ASIDE or (name not in _WHOLE or name == "article" and inner > 0) and _other(attributes))
        if not other and name not in _BLOCK and name not in _ASIDE and not opened[name]:
            continue  # an element within a line; within a hidden one of its name it counts, so that the right end tag ends that
        flush()
        anchors = 0
        if name == "hr":
            continue
        before = bool(article)
        if kind == "close":
            if opened[name]:
                while pop() != name:
                    pass
        else:
            if stack and (name in _SELF and stack[-1][0] == name or name in _BLOCK and name not in _SELF and stack[-1][0] == "p"):
                pop()
            stack.append((name, other))
            opened[name] += 1
            hidden += other
            if name in ("article", "main"):
                articles += not article
                article.append(articles)
                inner += name == "article"
        if name not in _SELF and not (before and article):
            out.append(("", 0, False, 0))
    flush()
    return out


def weighed(lines: list[Line], window: int = WINDOW) -> list[tuple[str, int, bool]]:
    """(text, weight, whether it is an article's): the lines that windows slide over.

    Between lines of different articles, or of one and none, stand as many empty lines as a window has. Hidden lines have weight 0 and no text, and have no place within an article.
    """
    out: list[tuple[str, int, bool]] = []
    now = 0
    for text, free, never, number in lines:
        if number != now:
            out += [("", 0, False)] * window
            now = number
        if not number:
            out.append(("", 0, False) if never else (text, free, False))
        elif not never:
            out.append((text, ARTICLE * len(text), True))
    return out


def main_text(page: str | None, window: int = WINDOW, near: float = NEAR) -> str:
    """The page's main text, a line for each block; '' for null, empty or text-less pages."""
    lines = weighed(strip(page or ""), window)
    upto = [0]
    for _, weight, _ in lines:
        upto.append(upto[-1] + weight)
    before, after, n = (window - 1) // 2, window // 2 + 1, len(lines)
    sums = [upto[min(i + after, n)] - upto[max(i - before, 0)] for i in range(n)]
    regions, i = [], 0
    while i < n:
        j = i
        while j < n and sums[j]:  # from a surge to its dive
            j += 1
        if j > i:
            regions.append((max(sums[i:j]), any(x[2] for x in lines[i:j]), i, j))
        i = j + 1
    highest, of_article, *_ = max(regions, default=(0, False))
    least = near * highest if of_article else 0
    return "\n".join(lines[k][0] for peak, _, i, j in regions if peak >= least for k in range(i, j) if lines[k][0])


def extract(pages: DataFrame, source: str = "html", name: str = "text") -> DataFrame:
    """pages with the main text of each whole page. A column of that name is replaced, unless it is the source."""
    rest = pages if name == source else pages.drop(name)
    keep = [c for c in rest.columns if c != name]
    schema = schema_with(rest.select(*keep), **{name: T.StringType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(source)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, name])

    return rest.mapInArrow(run, schema)


def op9_query(pages: DataFrame) -> DataFrame:
    """The main text of every page. Null, empty and text-less pages have '' and 0; repeated rows and null ids are rows like any other."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
