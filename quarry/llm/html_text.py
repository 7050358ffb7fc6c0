"""Operator 6: main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one labels each block from its stop-word
density, length and link density, and from the container it stands in (menus, headers,
footers, sidebars, notices, adverts, forms and comment lists are boilerplate whatever their
words). Short blocks and those of middling density stay ambiguous; pass two gives them the label of
the nearest neighbours decided by their words (both must be content, or the one that exists; inside an article a
single content neighbour is enough). On a page whose language has no stop-word list, length and link density decide; a page
of which nothing but containers is decided keeps its ambiguous blocks of five words or more. Content blocks are joined in
page order by one space. A page is read in time linear in its length.

Edge cases: a null or empty page and a page without content have the empty text; unclosed,
unknown or cut-off tags and cut-off character references are read as far as they go (raw text like a script to
the end of the page, other elements without text to the next block-level tag); a quote is one only after an equals sign and
if another follows; repeated
rows are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

#: Common function words of the languages that are judged by density.
STOP_WORDS = frozenset("""
the of and to in a is that it for was on are as with his they be at one have this from or had by but not what all
were when we there can an your which their if do will how about
le la les de des du un une et est en que qui dans pour par sur au aux avec ne pas ce se sont plus ou
der die das und ist nicht ein eine zu den von mit sich des auf im dem als auch es an werden aus er hat dass
el los las una y que no por con para su al lo como del se es
""".split())
#: Elements that are never article text.
_RAW = {"script", "style", "noscript", "template", "iframe", "textarea"}
_SKIP = _RAW | {"svg", "object", "canvas", "head", "select", "button", "math", "audio", "video", "map"}
_BOILER = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "label"}
_ARTICLE = {"article", "main"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog",
          "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
          "header", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary",
          "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "title", "label"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: These hold no paragraphs: a block-level tag before their end ends them.
_PHRASE = {"button", "select"}
_CLOSES_ITSELF = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|breadcrumbs?|comments?|cookies?|consent|disclaimer|disqus|"
    r"footer|gdpr|legal|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pager|pagination|popup|"
    r"promos?|promoted|recommended|related|replies|reply|respond|share|sharing|shoutbox|sidebar|signup|skip|social|"
    r"sponsor(?:ed)?|subscribe|toolbar|topbar|widget)(?:$|[\s_-])", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"}
_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_PLAIN = re.compile(r"[^'\">]*+")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")

#: Pass-one limits: link density, characters of a short and of a long block, stop-word densities.
MAX_LINKS, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.33, 70, 200, 0.10, 0.20
#: Share of stop words below which a page's language has no list, words of a sentence.
LISTED, SENTENCE = 0.05, 5
GOOD, BAD, UNSURE = 1, 0, None


class Page:
    """Markup items of a page by place. What a search found stays noted until the place has passed it, so
    that the page is read once for each kind of end whatever its markup."""

    def __init__(self, page: str):
        self.page, self.ends, self.closes = page, {}, {}

    def end(self, what: str, at: int) -> int:
        """Place of ``what`` at or after ``at``, or -1."""
        last = self.ends.get(what, -2)
        if last != -1 and last < at:
            last = self.ends[what] = self.page.find(what, at)
        return last

    def close(self, tag: str, at: int) -> tuple[int, int] | None:
        """(begin, end) of the next closing tag."""
        last = self.closes.get(tag, (-1, -1))
        if last is not None and last[0] < at:
            m = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(self.page, at)
            last = self.closes[tag] = m.span() if m else None
        return last

    def item(self, at: int) -> tuple[int, int, str, str, str, bool] | None:
        """(begin, end, literal text, tag in lower case or '', attributes, closing) of the next item.
        Quotes enclose a value after an equals sign only, and only if another of their kind follows."""
        page = self.page
        m = _OPEN.search(page, at)
        if not m:
            return None
        if m[2] is None:
            what = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
            z = self.end(what, m.end())
            z, after = (len(page), len(page)) if z < 0 else (z, z + len(what))
            return m.start(), after, page[m.end():z] if m[0] == "<![CDATA[" else "", "", "", False
        i = m.end()
        while True:
            begin, i = i, _PLAIN.match(page, i).end()
            if i >= len(page) or page[i] == ">":
                break
            k = i - 1
            while k > begin and page[k].isspace():
                k -= 1
            z = self.end(page[i], i + 1) if page[k] == "=" else -1
            i = i + 1 if z < 0 else z + 1
        return m.start(), min(i + 1, len(page)), "", m[2].lower(), page[m.end():i], bool(m[1])


def is_boiler(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _BOILER or tag == "header" and not in_article:
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for name, a, b, c in _ATTR.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id") and tag not in ("body", "html") and tag not in _ARTICLE and _NAMES.search(value):
            return True
        if name == "role" and value.lower() in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def blocks(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters in links, boilerplate container, inside an article) in page order."""
    out: list[tuple[str, int, bool, bool]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # open containers: (tag, boilerplate, article)
    linked = links = 0
    boiler = article = False

    def flush() -> None:
        nonlocal linked
        joined = _SPACE.sub(" ", "".join(text)).strip()
        if joined:
            out.append((joined, linked, boiler, article))
        text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        piece = _html.unescape(piece)
        text.append(piece)
        if links:
            linked += len(piece.strip())

    source, at = Page(page), 0
    muted, mute_ends = "", frozenset()  # an element without text, read through to its end
    while (item := source.item(at)) is not None:
        begin, end, literal, tag, attributes, closing = item
        if begin > at and not muted:
            add(page[at:begin])
        at = end
        if literal and not muted:
            add(literal)
        if not tag:
            continue
        if muted and (tag == muted if closing else tag in mute_ends):
            muted = ""
            if closing:
                continue
        if muted:
            continue
        if tag in _BLOCK:
            flush()
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    boiler, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                    break
        elif tag in _SKIP:
            close = None if attributes.rstrip().endswith("/") else source.close(tag, at)
            if close and tag not in _PHRASE:
                at = close[1]
            elif attributes.rstrip().endswith("/") or tag == "head":
                pass
            elif tag in _RAW:
                at = len(page)
            else:
                muted, mute_ends = tag, _BLOCK - {"option", "br", "hr"} - ({"div"} if close else set())
        elif tag == "a":
            links += 1
        elif tag not in _VOID and (tag in _BLOCK or is_boiler(tag, attributes, article)):
            links = 0 if tag in ("p", "div", "article", "section", "h1") else links
            if tag in _CLOSES_ITSELF and stack and stack[-1][0] == tag:
                stack.pop()
                boiler, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            boiler = boiler or is_boiler(tag, attributes, article)
            article = article or tag in _ARTICLE
            stack.append((tag, boiler, article))
    if at < len(page) and not muted:
        add(page[at:])
    flush()
    return out


def listed(found: list[tuple[str, int, bool, bool]]) -> bool:
    """Whether the stop words speak of this page: enough of its words outside boilerplate are among them."""
    words = [w for text, _, boiler, _ in found if not boiler for w in _WORD.findall(text.lower())]
    return sum(w in STOP_WORDS for w in words) >= LISTED * len(words)


def first_pass(text: str, linked: int, boiler: bool, article: bool, by_words: bool = True):
    if boiler:
        return BAD
    words = _WORD.findall(text.lower())
    if not words and not article:
        return UNSURE
    if linked / len(text) > MAX_LINKS:
        return BAD
    if len(text) < SHORT:
        return UNSURE if not linked else BAD
    if not by_words:  # length and links decide
        return GOOD if len(text) > LONG else UNSURE
    density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if density >= STOP_HIGH:
        return GOOD if len(text) > LONG or article else UNSURE
    if density >= STOP_LOW or article:
        return UNSURE
    return BAD


def labels(found: list[tuple[str, int, bool, bool]]) -> list[bool]:
    """Content or not, for each block: pass one, then neighbours for the ambiguous."""
    by_words = listed(found)
    first = [first_pass(*b, by_words) for b in found]
    if GOOD not in first and not any(x is BAD and not b[2] for x, b in zip(first, found, strict=True)):
        # nothing decided but containers: the ambiguous blocks with a sentence are all the page has
        return [x is UNSURE and (b[3] or len(_WORD.findall(b[0])) >= SENTENCE) for x, b in zip(first, found, strict=True)]
    # a container's label is its own: only blocks judged by their words are neighbours
    decided = [UNSURE if b[2] else x for x, b in zip(first, found, strict=True)]
    before, last = [], UNSURE
    for x in decided:
        before.append(last)
        last = x if x is not UNSURE else last
    after, last = [], UNSURE
    for x in reversed(decided):
        after.append(last)
        last = x if x is not UNSURE else last
    out = []
    for (_, _, _, article), x, a, b in zip(found, first, before, reversed(after), strict=True):
        if x is UNSURE:
            near = [y for y in (a, b) if y is not UNSURE]
            x = any(near) or article and GOOD not in first if article else bool(near) and all(near)
        out.append(bool(x))
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return " ".join(b[0] for b, good in zip(found, labels(found), strict=True) if good)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of ``pages(page_id, url, html)``."""
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in common.slices(big, "html"):
                text = [main_text(x) for x in b.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column("page_id"), b.column("url"), pa.array(text, pa.string()),
                     pa.array([len(x) for x in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                        F.col("html").cast("string")).mapInArrow(run, schema)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
