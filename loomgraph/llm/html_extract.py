"""Main text of HTML pages by two-pass block rules.

First pass: each block of text is good, bad or undecided by where it stands (menus, footers, forms and
the like are bad), its link density, its length and its stop-word density.  Second pass: an undecided
block takes the label of the nearest decided neighbour, a heading that of the next one; inside an article
element only the article's own blocks count as neighbours.

Stop words are those of four languages.  On a page where no long block has them, its language is unknown,
and long blocks are judged by their links alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import bounded_batches

SHORT_CHARS = 70
GOOD_DENSITY = 0.2
BAD_LINKS = 0.5
#: Of an unknown language, the share of linked text up to which a long block is good.
FEW_LINKS = 0.2
#: A form or an element with a telling class name is the page's own text if it holds more than this share of what is not linked.
MOST_SHARE = 0.5
# Frequent function words of the corpus languages.
STOP_WORDS = {
    "en": "a about all also an and are as at be been but by can for from had has have he her his if in into is it its more not of on one or other she so some than that the their them there these they this to was we were what when which who will with would you",
    "de": "aber als am an auch auf aus bei bis da das dass dem den der des die durch ein eine einem einen einer eines er es für hat haben ich im in ist kann mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn werden wie wird wir zu zum zur",
    "fr": "à au aux avec ce ces cette dans de des du elle en est et été être il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa sans se ses son sont sur tout très un une vous y",
    "es": "a al como con cuando de del desde donde el ella en entre era es esta este fue ha han hay la las le lo los más me muy no o para pero por que se ser si sin sobre son su sus también un una uno y ya",
}
_STOP = [frozenset(words.split()) for words in STOP_WORDS.values()]
# Elements by their part in the page.
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "select", "button", "noframes", "xmp"}
_BOILER = {"nav", "footer", "aside", "form", "menu", "dialog", "header"}
_MAIN = {"article", "main"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_NESTED = {"article", "aside", "blockquote", "details", "dialog", "div", "fieldset", "figure", "footer", "form", "header", "main", "menu", "nav", "ol", "section", "table", "td", "ul"}
_BOILER_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|byline-share|comments?|comment-?list|respond|disqus|consent|cookies?|copyright|dropdown|footer|gdpr|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pagination|pager|popup|promo\w*|recommended|related|search|share|sharing|sidebar|signup|site-?header|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])", re.I)
#: Elements that end where the next block begins, whether closed or not.
_SHORT = {"p", "li", "dt", "dd", "td", "th", "tr"}
#: Elements without content.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Parts of a page beside its text, by their role.
_ROLES = {"alert", "alertdialog", "complementary", "contentinfo", "dialog", "menu", "menubar", "navigation", "search", "status"}
_ROLE = re.compile(r"""\brole\s*=\s*["']?([a-z]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=$|[\s/=])(?!\s*=\s*["']?until-found)|\baria-hidden\s*=\s*["']?true|\bstyle\s*=\s*(?:"[^"]*|'[^']*)(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Class names that say what an element has or lacks, not what it is.
_ABOUT = re.compile(r"(?:has|with|without|no|is|show|hide)[_-]", re.I)
#: Names of what is never the page's own text, however much of it there is.
_NEVER_NAME = re.compile(r"(?:^|[_-])(?:ads?|advert\w*|adsense|sponsor\w*|comments?|comment-?list|respond|disqus|consent|cookies?|gdpr)(?:$|[_-])", re.I)
_WIDE = re.compile(r"[⺀-鿿가-힯豈-﫿]")
_TAG_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_QUOTE_OR_END = re.compile(r"""[>"']""")
#: Characters within which a quote in a tag must close; one that doesn't counts as a character.
MOST_QUOTED = 65_536
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[^\W\d_]+")


def next_tag(page: str, at: int, last: int) -> tuple[int, int, bool, str, str]:
    """(start, end, closing, name, attributes) of the first tag from `at` on; a comment and the like has no name.

    last is the place of the page's last `>`: behind it nothing is a tag, so that a page of open tags is read once.
    """
    while True:
        start = page.find("<", at)
        if start < 0 or start > last:
            return len(page), len(page), False, "", ""
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            return start, stop + 3 if stop >= 0 else len(page), False, "", ""
        m = _TAG_NAME.match(page, start + 1)
        if m is None:
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                return start, page.index(">", start) + 1, False, "", ""
            at = start + 1
            continue
        place = m.end()
        first = end = page.index(">", place)
        while True:
            q = _QUOTE_OR_END.search(page, place)
            if q is None or q[0] == ">":
                end = q.start() if q else first
                break
            close = page.find(q[0], q.end(), q.end() + MOST_QUOTED)
            if close < 0:
                end = first
                break
            place = close + 1
        return start, end + 1, bool(m[1]), m[2].lower(), page[m.end() : end]


def after_hidden(page: str, at: int, last: int, tag: str) -> int | None:
    """Where a hidden element that begins before `at` ends; None if it never does."""
    depth = 1
    while True:
        start, stop, closing, name, attributes = next_tag(page, at, last)
        if start >= len(page):
            return None
        if tag in _SHORT and name in _BLOCK:
            return stop if closing and name == tag else start
        if name == tag:
            depth += -1 if closing else not attributes.endswith("/")
            if not depth:
                return stop
        at = stop


@dataclass
class Block:
    text: str
    links: int
    boiler: bool
    main: bool
    heading: bool = False
    label: str = ""

    @property
    def size(self) -> int:
        """Characters; of scripts without spaces each counts twice."""
        return len(self.text) + (0 if self.text.isascii() else len(_WIDE.findall(self.text)))


def boiler_names(attributes: str) -> list[str]:
    """The class names, id and role that mark an element as something beside the text."""
    tokens = [t for a, b, c in _NAMES.findall(attributes) for t in (a or b or c).split()]
    return [t for t in tokens if _BOILER_NAME.search(t) and not _ABOUT.match(t)]


def blocks_of(page: str) -> list[Block]:
    """The page's non-empty blocks in order; hidden elements have none.  One scan, linear in the page."""
    blocks: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []
    on_stack: Counter[str] = Counter()
    parts: list[str] = []
    links = depth = breaks = 0
    kind = ""
    inside: list[int] = []  # by block: the innermost marked element around it, or -1
    marked: list[bool] = []  # by marked element: whether it is marked for good
    outer: list[int] = []  # by marked element: the marked element around it

    def close() -> None:
        nonlocal links, breaks
        breaks = 0
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                boiler, main, around = stack[-1][1:] if stack else (False, False, -1)
                blocks.append(Block(text, links, boiler, main, kind in _HEADINGS))
                inside.append(around)
            parts.clear()
        links = 0

    def show(raw: str) -> None:
        nonlocal links, breaks
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if not text.isspace():
                breaks = 0
                if depth:
                    links += len(text)

    at, end, last = 0, len(page), page.rfind(">")
    endless: set[str] = set()  # raw or hidden elements of which no end follows
    while at < end:
        start, stop, closing, tag, attributes = next_tag(page, at, last)
        show(page[at:start])
        at = stop
        if not tag:
            continue
        if tag in _RAW:
            if not closing and not attributes.endswith("/"):
                over = None if tag in endless else re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at, last + 1)
                if over is None:
                    endless.add(tag)
                at = over.end() if over else (end if tag in ("script", "style", "title", "textarea") else at)
            parts.append(" ")
            continue
        if not closing and attributes and tag not in _VOID and tag not in endless and _HIDDEN.search(attributes):
            beyond = after_hidden(page, at, last, tag)
            if beyond is not None:
                if tag in _BLOCK:
                    close()
                at = beyond
                continue
            endless.add(tag)
        if tag == "a":
            depth = max(0, depth - 1) if closing else 1
            continue
        if tag == "br":
            breaks += 1
            parts.append(" ")
            if breaks > 1:
                close()
            continue
        if tag not in _BLOCK:
            continue
        close()
        depth, kind = 0, "" if closing else tag
        if tag not in _NESTED:
            continue
        if closing:
            while on_stack[tag]:
                ended = stack.pop()[0]
                on_stack[ended] -= 1
                if ended == tag:
                    break
            continue
        boiler, main, around = stack[-1][1:] if stack else (False, False, -1)
        role = _ROLE.search(attributes) if attributes else None
        if tag in _MAIN:
            main = True
        elif (tag in _BOILER and tag != "form" and not (tag == "header" and main)) or (role and role[1].lower() in _ROLES):
            boiler = True
        names = boiler_names(attributes) if attributes else []
        if names or tag == "form":
            outer.append(around)
            around = len(marked)
            marked.append(any(_NEVER_NAME.search(n) for n in names))
        stack.append((tag, boiler, main, around))
        on_stack[tag] += 1
    close()
    own = [0 if b.boiler else len(b.text) - b.links for b in blocks]
    held = [0] * len(marked)
    for n, k in zip(own, inside, strict=True):
        if k >= 0:
            held[k] += n
    for k in range(len(marked) - 1, -1, -1):  # an element comes behind the one around it
        if outer[k] >= 0:
            held[outer[k]] += held[k]
    total = sum(own)
    beside: list[bool] = []
    for k, n in enumerate(held):
        beside.append(marked[k] or n <= MOST_SHARE * total or (outer[k] >= 0 and beside[outer[k]]))
    for b, k in zip(blocks, inside, strict=True):
        b.boiler = b.boiler or (k >= 0 and beside[k])
    return blocks


def stop_density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return max(sum(w in own for w in words) for own in _STOP) / len(words) if words else 0.0


def first_pass(b: Block, known: bool) -> str:
    """The block's label, or '' for undecided.  known: whether the page's language is."""
    if b.boiler:
        return "bad"
    if b.links > BAD_LINKS * len(b.text):
        return "" if b.heading else "bad"
    if b.size < SHORT_CHARS:
        return ""
    if known:
        return "good" if stop_density(b.text) >= GOOD_DENSITY else ""
    return "good" if b.links <= FEW_LINKS * len(b.text) else ""


def main_text(page: str | None) -> str:
    """The main text: good blocks joined by an empty line."""
    if not page:
        return ""
    blocks = blocks_of(page)
    has_main = any(b.main and not b.boiler for b in blocks)
    known = any(not b.boiler and b.size >= SHORT_CHARS and stop_density(b.text) >= GOOD_DENSITY for b in blocks)
    for b in blocks:
        b.label = "bad" if has_main and not b.main else first_pass(b, known)
    # A menu beside a block says nothing about it, nor what is outside its article.
    decided = ["" if b.boiler or b.main != has_main else b.label for b in blocks]
    before, after = _nearest(decided), _nearest(decided[::-1])[::-1]
    for i, b in enumerate(blocks):
        if not b.label:
            (da, la), (db, lb) = before[i], after[i]
            if b.heading and db < float("inf"):
                b.label = lb
            else:
                b.label = la if da < db or la == lb else lb if db < da else "good" if b.main else "bad"
    return "\n\n".join(b.text for b in blocks if b.label == "good")


def _nearest(labels: list[str]) -> list[tuple[float, str]]:
    """By place: distance to, and label of, the last decided one before; where there is none, far away and good."""
    out, last, label = [], None, "good"
    for i, x in enumerate(labels):
        out.append((i - last if last is not None else float("inf"), label))
        if x:
            last, label = i, x
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(t.as_py()) for t in batch.column("html")]
        names = [c for c in batch.schema.names if c != "html"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts, pa.string())], names=[*names, "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, url, text, n_chars (code points).

    A null or empty page, and one of menus and the like alone, has the empty text; so has a page whose
    blocks are all short and stand beside bad ones only.  Repeated rows each get their row; further columns
    are not read; an empty table gives an empty result.
    """
    bounded_batches(pages.sparkSession)
    given = pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), F.col(html_col).alias("html"))
    schema = given.select("i", "u", F.lit(None).cast("string").alias("text")).schema
    return given.mapInArrow(_extract, schema).select(F.col("i").alias(id_col), F.col("u").alias(url_col), "text", F.length("text").cast("bigint").alias("n_chars"))
