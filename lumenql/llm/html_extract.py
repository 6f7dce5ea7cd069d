"""Main-text extraction with two-pass block rules."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of elements in the HTML standard, and common class or id words of page furniture.
RAW = "script style noscript template iframe object svg math head title textarea select button canvas audio video".split()
FURNITURE = "nav footer aside form menu dialog header".split()
BLOCKS = (
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre search section summary table tbody td tfoot th thead tr ul"
).split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
MARKS = (
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent "
    "cookie cookies copyright disclaimer disqus footer gdpr header hidden masthead menu modal nav navbar navigation "
    "newsletter notice notices outbrain pagination pager paywall popup promo promoted promotion recommended related replies "
    "reply respond share sharing sidebar signup skip social sponsor sponsored subscribe taboola toolbar topbar warning widget"
).split()
ROLES = "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
#: Elements that end, unclosed, where the next of the name begins.
CLOSED_BY_NEXT = "p li dt dd option h1 h2 h3 h4 h5 h6".split()
BODY_MARKS = "article articlebody body content entry main maincontent post postbody postcontent story text".split()
STOP_WORDS = set(
    # English
    "a about after all also an and are as at be because been but by can could do for from had has have he her his i if in into is it "
    "its more no not of on one or other our out she so some than that the their them then there these they this to up was we were "
    "what when which who will with would you your "
    # German
    "aber als am an auch auf aus bei bin das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in "
    "ist kann mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur "
    # French
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui "
    "sa se ses son sont sur un une vous y été "
    # Spanish
    "al como con de del el ella en es esta este ha la las le lo los más me mi no o para pero por que se si sin sobre su sus un una y ya"
    .split()
)

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTED = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+")
_ATTR = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?")
_BIG = re.compile(r"&#(?:[0-9]{10,}|[xX][0-9a-fA-F]{9,});?")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W_]+")
_SPLIT = re.compile(r"[^a-z0-9]+")
_RAW, _FURNITURE, _BLOCKS, _VOID, _MARKS, _ROLES, _BODY, _CLOSED_BY_NEXT = map(set, (RAW, FURNITURE, BLOCKS, VOID, MARKS, ROLES, BODY_MARKS, CLOSED_BY_NEXT))
GOOD, BAD, SHORT = 1, -1, 0


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    furniture: bool  # inside a menu, footer, advert, form, comment list, ...
    article: int  # which article or main element it is in, 0 for none
    heading: bool
    label: int = SHORT


class _Reader:
    """A page's tags, in time linear in its length: what is searched for and isn't there isn't searched for again."""

    def __init__(self, page: str) -> None:
        self.page, self.end = page, len(page)
        self.lower: str | None = None
        self.missing: set[str] = set()
        self.quotes = True  # until one swallows the rest of the page; from then on tags end at the next >

    def find(self, what: str, at: int) -> int:
        """Place of ``what`` in the page with A-Z lower-cased; -1 if there is none from ``at`` on, where places ascend."""
        if what in self.missing:
            return -1
        if self.lower is None:
            self.lower = self.page.lower()
            if len(self.lower) != self.end:  # a letter whose lower case is longer
                self.lower = re.sub("[A-Z]", lambda c: c[0].lower(), self.page)
        to = self.lower.find(what, at)
        if to < 0:
            self.missing.add(what)
        return to

    def tag(self, at: int) -> tuple[int, int, str, str, str]:
        """(its place, the end, name, "/" if it closes, attributes) of the next tag; comments and the like have no name, CDATA has its text
        as attributes. The place is the page's end where no tag is left."""
        page, end = self.page, self.end
        while 0 <= (at := page.find("<", at)) < end - 1:
            c = page[at + 1]
            if c in "!?":
                for opens, closes in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
                    if page.startswith(opens, at):
                        to = self.find(closes, at + len(opens))
                        last = end if to < 0 else to
                        return at, end if to < 0 else to + len(closes), "", "", page[at + 9 : last] if opens[-1] == "[" else ""
            m = _NAME.match(page, at + 1 + (c == "/"))
            if m:
                to = _QUOTED.match(page, m.end()).end() if self.quotes else end
                if to >= end or page[to] != ">":
                    self.quotes = False
                    to = self.find(">", m.end())
                if to < 0:
                    return end, end, "", "", ""
                return at, to + 1, m[0].lower(), "/" if c == "/" else "", page[m.end() : to]
            at += 1
        return end, end, "", "", ""


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order; scripts, styles, comments and markup are gone."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, bool]] = []  # element, furniture, article, whether it is a link
    held: Counter[str] = Counter()  # elements on the stack by name
    parts: list[str] = []
    linked = n_articles = 0
    heading = last_break = False
    links = 0

    def flush() -> None:
        nonlocal parts, linked, heading
        if parts:
            text = _SPACE.sub(" ", html.unescape(_BIG.sub("\ufffd", "".join(parts)))).strip()
            if text:
                _, fur, art, _ = stack[-1] if stack else ("", False, 0, False)
                out.append(Block(text, linked, fur, art, heading))
        parts, linked = [], 0

    def drop(to: int) -> None:
        nonlocal links
        for x in stack[to:]:
            links -= x[3]
            held[x[0]] -= 1
        del stack[to:]

    reader = _Reader(page)
    at, end = 0, len(page)
    while at < end:
        begin, after, name, closing, attrs = reader.tag(at)
        text = page[at:begin]
        if text:
            if links:
                linked += len(text.strip())
            parts.append(text)
            if not text.isspace():
                last_break = False
        if begin >= end:
            break
        at = after
        if not name:
            if attrs:
                parts.append(html.escape(attrs))
            continue
        if closing:
            if name in _BLOCKS:
                flush()
                heading = False
            if held[name] and (name in _BLOCKS or name == "a"):
                to = len(stack) - 1
                while stack[to][0] != name:
                    to -= 1
                drop(to)
            continue
        if name in _RAW and not attrs.rstrip().endswith("/"):
            to = reader.find(f"</{name}", at)
            if name == "head" and (body := reader.find("<body", at)) >= 0 and (to < 0 or body < to):
                at = body
                continue
            if to < 0 and name in ("script", "style", "textarea", "title"):
                at = end
            elif to >= 0:
                gt = reader.find(">", to)
                at = end if gt < 0 else gt + 1
            continue
        if name == "br":
            if last_break:
                flush()
            parts.append("\n")
            last_break = True
            continue
        last_break = False
        if name in _BLOCKS:
            flush()
            heading = len(name) == 2 and name[0] == "h" and name[1].isdigit()
        if name in _VOID or attrs.rstrip().endswith("/"):
            continue
        if name in _BLOCKS or name == "a":
            if name == "a" and stack and stack[-1][0] == "a":
                drop(len(stack) - 1)  # links don't nest
            if name in _CLOSED_BY_NEXT:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name and not (name in ("li", "dt", "dd") and any(s[0] in ("ul", "ol", "dl") for s in stack[i:])):
                        drop(i)
                        break
                    if stack[i][0] != "a":
                        break
            _, fur, art, _ = stack[-1] if stack else ("", False, 0, False)
            tokens: set[str] = set()
            body = hidden = False
            if attrs and name not in ("a", "html", "body"):
                for k, *v in _ATTR.findall(attrs):
                    k, value = k.lower(), "".join(v).lower()
                    if k in ("class", "id"):
                        tokens.update(_SPLIT.split(value))
                        body |= any(_SPLIT.sub("", x) in _BODY for x in value.split())
                    elif k == "role":
                        fur |= value in _ROLES
                        body |= value in ("main", "article")
                    elif k == "aria-hidden" and value == "true" or k == "style" and "display:none" in value.replace(" ", ""):
                        fur = True
                    elif k == "hidden":
                        hidden = True
                fur |= hidden and "hidden" not in tokens
            if name in _FURNITURE and not (name == "header" and art):
                fur = True
            elif name in ("article", "main") or body and not tokens & _MARKS:
                if not (art and name not in ("article", "main")):
                    n_articles += 1
                    art = art or n_articles
            elif tokens & _MARKS and not (tokens & {"header"} and not tokens & (_MARKS - {"header"}) and art):
                fur = True
            stack.append((name, fur, art, name == "a"))
            held[name] += 1
            links += name == "a"
    flush()
    return out


def classify(blocks: list[Block], low: float = 0.05, high: float = 0.2, links: float = 0.35, short: int = 70, long: int = 160) -> list[Block]:
    """The two passes. First each block for itself: furniture, or too much of it linked (more is allowed inside an article): bad; long with
    enough stop words, or of middle length with many: good; long with few: bad outside an article, undecided inside, where tables and
    listings are text too; the rest is short, thus undecided. Where a page has an article, what lies outside is good at no density.

    Then undecided blocks take the label of the nearest decided neighbours, the preceding and the following, furniture left out: where they
    agree, that; else that of the nearer one in characters, the preceding if they are equally near; a heading that of what follows. What lies beyond the
    edge of an article or main element is no neighbour. Where an article has no good block of its own, as all are short, its
    mark stands in for one, and only linked blocks are bad; a page without article and without good block is bad."""
    any_article = any(b.article for b in blocks)
    for b in blocks:
        n = len(b.text)
        words = _WORD.findall(b.text.lower())
        stop = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
        if b.furniture or b.linked > (0.7 if b.article else links) * n:
            b.label = BAD
        elif n >= long and stop >= low or n >= short and stop >= high:
            b.label = GOOD if b.article or not any_article else SHORT
        elif n >= long and not b.article:
            b.label = BAD
        else:
            b.label = SHORT
    first = [b.label for b in blocks]
    proved = {b.article for b in blocks if b.label == GOOD}

    def reach(order: Iterable[int]) -> list[tuple[int, int]]:
        """For each block the label of the decided one before it in this order, SHORT for none, and the characters between."""
        out = [(SHORT, 0)] * len(blocks)
        last: dict[int, tuple[int, int]] = {}  # by article: label, characters since
        beyond = None
        for i in order:
            b = blocks[i]
            if b.article != beyond:
                last.clear()
                beyond = b.article
            label, away = last.get(b.article, (SHORT, 0))
            out[i] = label, away
            if first[i] != SHORT and not (b.furniture and b.article):
                last[b.article] = first[i], 0
            elif label != SHORT:
                last[b.article] = label, away + len(b.text)
        return out

    ahead, behind = reach(range(len(blocks))), reach(range(len(blocks) - 1, -1, -1))
    for i, b in enumerate(blocks):
        if first[i] != SHORT:
            continue
        if b.article not in proved:
            b.label = GOOD if b.article else BAD
            continue
        (before, x), (after, y) = ahead[i], behind[i]
        before, after = before or after or BAD, after or before or BAD
        b.label = after if b.heading or y < x else before
    return blocks


def main_text(page: str | None) -> str:
    """The article's text: good blocks in page order, one a line."""
    return "\n".join(b.text for b in classify(blocks_of(page)) if b.label == GOOD) if page else ""


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with text (empty where the html is null, empty or holds no article) and
    n_chars, its length in code points. One row per row; a column named text or n_chars is replaced."""
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    given = pages.select(*keep, html_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"]
            )

    return given.mapInArrow(run, f"{schema}{', ' if keep else ''}text string, n_chars long").select(*keep, F.col("text"), F.col("n_chars"))
