"""Main text of web pages: the best scoring contiguous region of words and tags.

A page is a sequence of words, which score positive, and tags, which score negative; one linear scan finds
the contiguous part of the highest sum. Tags' weights come from pages whose markup labels their content (an
article element): a tag that stands outside the article more often than inside costs more, by the logarithm of
the ratio; tags are told apart by name, direction and class words. The labelled pages are a bounded sample,
`max_labelled`, of the lowest hashes of the id. Elements that are never content (menus, forms, adverts, ...; by name, role or a whole
class token or id, or a piece of one that doesn't name a state, as no-sidebar does) score no words, within the content too; a piece makes the tag cost more besides. An
element with four fifths of the words (of its article or main element, or of a page without one) is not ruled out by a class or id that doesn't speak of comments,
and the id of a section or heading in the content is an anchor.
Where the region lies in article or main elements, the bounds of those with a quarter of the largest one's text replace the region's; else those of the
smallest section of the page (div, section, table cell) that holds all of it, if there is one below the body.

Text: character references decoded, white space in a block one space, trimmed, blocks joined by a line break.

Cases: a null page is empty; an empty page, and one without words, has an empty text. Markup that is cut short
ends at the page's end, so a tag without its `>` takes the rest; a `<` that opens no tag is text. Repeated rows give a row each, null ids stay
null. Columns `text` and `n_chars` of the input are replaced, others pass through. An empty table gives an empty result.
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

# Names of HTML elements and usual class names.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre section summary table tbody tfoot thead tr ul".split())
SPACED = {"br", "td", "th"}
NEVER = set("head nav aside form footer noscript template svg select button dialog menu object audio video canvas".split())
PAGE_ONLY = {"header"}
SECTIONS = {"div", "section", "td", "article", "main", "center"}
CONTENT = {"article", "main"}
#: What may not stay open inside these.
CLOSED_BY_BLOCK = {"p"}
NOT_CONTENT = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar aside menu nav navbar navigation breadcrumb breadcrumbs pagination "
    "header masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments commentlist respond replies disqus widget toolbar search".split()
)
COMMENTS = set("comment comments commentlist respond replies disqus".split())
#: Elements whose class and id say what the page or a heading has, not what the element is.
NEUTRAL = {"html", "body", "main", "article", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements whose ids in the content are anchors that links lead to.
ANCHORS = {"section", "p", "li", "a", "span", "figure", "table", "dl", "dt", "dd", "blockquote"}
#: Pieces of class tokens that say how a page or element is, not what it is.
STATES = set("no has with without not is open closed fixed enabled disabled on off".split())
#: What a tag costs more of whose class or id a piece, but no whole token, is in NOT_CONTENT; such keys start with the mark.
DOUBT, DOUBT_MARK = 8.0, "?"
#: Stands for an element's name, role or style among what says that it isn't content.
HARD = -1
NOT_CONTENT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_TO_QUOTE = re.compile("[^\"'>]*")
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
_CLASS_WORD = re.compile("[a-z0-9]+")


class Page:
    """The blocks of a page, and its words and tags in order.

    blocks: (text, content element's number or -1, whether it may be content); events: (tag key or None for words,
    number of words, block's number); section: of each block the innermost section's number or -1; outer: of each
    section the one around it.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, bool]] = []
        self.events: list[tuple[str | None, int, int]] = []
        self.section: list[int] = []
        self.outer: list[int] = []
        # name, what says that it isn't content (numbers of elements by class or id, HARD for all else), content element, section
        self._open: list[tuple[str, tuple[int, ...], int, int]] = []
        self._excluded: list[tuple[int, ...]] = []  # of each block
        self._n_excluding = 0
        self._text: list[str] = []
        self._elements = 0
        self._n_open: Counter[str] = Counter()  # by name: an end tag without its start costs nothing
        self._no_end: set[int] = set()  # opening quotes from which no tag's end is found
        self._read(source)
        self._end_block()
        if self._n_excluding:
            self._lift()

    def _lift(self) -> None:
        """What has four fifths of the words is no menu, whatever its class or id says: of those of its content element, or of a page that has none."""
        per_page = not any(may and element >= 0 for _, element, may in self.blocks)
        words: Counter[tuple[int, int]] = Counter()
        for (text, element, _), by in zip(self.blocks, self._excluded, strict=True):
            if HARD not in by and (per_page or element >= 0):
                of = -1 if per_page else element
                words.update({(of, x): text.count(" ") + 1 for x in (HARD, *by)})
        lifted = {x for (of, x), n in words.items() if x != HARD and 5 * n >= 4 * words[of, HARD]}
        if lifted:
            may = [lifted.issuperset(by) for by in self._excluded]
            self.blocks = [(text, element, m) for (text, element, _), m in zip(self.blocks, may, strict=True)]
            self.events = [(key, (self.blocks[b][0].count(" ") + 1) * may[b] if key is None else n, b) for key, n, b in self.events]

    def _state(self) -> tuple[tuple[int, ...], int]:
        return self._open[-1][1:3] if self._open else ((), -1)

    def _section(self) -> int:
        return self._open[-1][3] if self._open else -1

    def _end_block(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            self._text.clear()
            if text:
                never, element = self._state()
                self.events.append((None, 0 if never else text.count(" ") + 1, len(self.blocks)))
                self.blocks.append((text, element, not never))
                self.section.append(self._section())
                self._excluded.append(never)

    def _tag_end(self, source: str, at: int) -> int:
        """Of a tag from behind its name, the place of its `>` outside quoted values; else of the first `>`; -1 if there is none.

        A quote from which an earlier tag found no end has none for this one, so a page is read in linear time.
        """
        start, quotes = at, []
        while (at := _TO_QUOTE.match(source, at).end()) < len(source):
            if source[at] == ">":
                return at
            quotes.append(at)
            to = -1 if at in self._no_end else source.find(source[at], at + 1)
            if to < 0:
                break
            at = to + 1
        self._no_end.update(quotes)
        return source.find(">", start)

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            lt = source.find("<", at)
            if lt < 0:
                lt = end
            if lt > at:
                self._text.append(html.unescape(source[at:lt]))
            if lt == end:
                return
            if source.startswith("<!--", lt):
                to = source.find("-->", lt + 4)
                at = end if to < 0 else to + 3
            elif source.startswith(("<!", "<?"), lt):
                to = source.find(">", lt)
                at = end if to < 0 else to + 1
            elif m := _TAG.match(source, lt):
                to = self._tag_end(source, m.end())
                if to < 0:
                    return  # a tag cut off by the page's end
                at, name, closing, attrs = to + 1, m[2].lower(), bool(m[1]), source[m.end() : to]
                if name in RAW and not closing:
                    m = re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I).search(source, at)
                    at = end if m is None else m.end()
                    continue
                self._tag(name, closing, attrs)
            else:
                self._text.append("<")
                at = lt + 1

    def _tag(self, name: str, closing: bool, attrs: str) -> None:
        if name in BLOCKS:
            self._end_block()
        elif name in SPACED:
            self._text.append(" ")
        key, hard, by_class = ("/" if closing else "") + name, False, False
        if closing:
            for i in () if not self._n_open[name] else range(len(self._open) - 1, -1, -1):
                if self._open[i][0] == name:
                    self._leave(i)
                    break
        elif name not in VOID:
            if attrs.strip():
                hard, by_class, doubt, words = _never_content(attrs, self._state()[1] >= 0, name)
                key = DOUBT_MARK * doubt + key + "".join(f".{w}" for w in words)
            if name in BLOCKS and self._open and self._open[-1][0] in CLOSED_BY_BLOCK:
                self._n_open[self._open.pop()[0]] -= 1
            inside, element = self._state()
            never = inside
            if hard or name in NEVER or (name in PAGE_ONLY and element < 0):
                never = inside if HARD in inside else (*inside, HARD)
            elif by_class and HARD not in inside:
                never, self._n_excluding = (*inside, self._n_excluding), self._n_excluding + 1
            if name in CONTENT and not never and element < 0:
                element, self._elements = self._elements, self._elements + 1
            if (never, element) != (inside, self._state()[1]):
                self._end_inline()
            section = self._section()
            if name in SECTIONS:
                self.outer.append(section)
                section = len(self.outer) - 1
            self._open.append((name, never, element, section))
            self._n_open[name] += 1
        self.events.append((key, 0, -1))

    def _leave(self, i: int) -> None:
        before = self._state()
        if before != (self._open[i - 1][1:3] if i else ((), -1)):
            self._end_inline()
        self._n_open.subtract(x[0] for x in self._open[i:])
        del self._open[i:]

    def _end_inline(self) -> None:
        """Inline elements that aren't content end the words before them without ending the block's line."""
        self._end_block()


def _never_content(attrs: str, inside: bool = False, element: str = "div") -> tuple[bool, bool, bool, list[str]]:
    """Whether role or style say that an element isn't content, whether class or id do, whether a piece of them raises a doubt, and the class words that tell tags apart.

    inside: in an article or main element, whose own header is content and in which another article may be a comment.
    """
    words: list[str] = []
    hard = never = doubt = False
    neutral = element in NEUTRAL and not (inside and element == "article")
    other = NOT_CONTENT - {"header"} if inside else NOT_CONTENT
    for m in _ATTR.finditer(attrs):
        name, value = (m[1] or m[5]).lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            tokens = value.split()
            pieces = [p for p in (set(_CLASS_WORD.findall(t)) for t in tokens) if STATES.isdisjoint(p)]
            anchor = inside and name == "id" and element in ANCHORS
            if not neutral:
                hard |= not COMMENTS.isdisjoint(tokens) and (not anchor or element == "section")
            elif element == "article" and name == "class":
                hard |= any(not COMMENTS.isdisjoint(p) for p in pieces)
            if not neutral and not anchor:
                never |= not other.isdisjoint(tokens)
                doubt |= any(not other.isdisjoint(p) for p in pieces)
            if name == "class":
                words += sorted(set(_CLASS_WORD.findall(value)))[:4]
        elif name == "role":
            hard |= value in NOT_CONTENT_ROLES
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            hard = True
    return hard, never or doubt, doubt and not never, words


def _cost(key: str, weights: dict[str, float], default: float) -> float:
    plain = key.removeprefix(DOUBT_MARK)
    return weights.get(plain, weights.get(plain.split(".")[0], default)) + DOUBT * (plain != key)


def best_region(page: Page, weights: dict[str, float], default: float) -> tuple[int, int]:
    """[start, end) of the events whose scores have the largest sum; of equal sums the first."""
    best = total = 0.0
    start = 0
    found = (0, 0)
    for i, (key, words, _) in enumerate(page.events):
        total += words if key is None else -_cost(key, weights, default)
        if total > best:
            best, found = total, (start, i + 1)
        elif total <= 0:
            total, start = 0.0, i + 1
    return found


def _within(page: Page, section: int, around: int) -> bool:
    while section > around:  # a section's number is larger than those around it
        section = page.outer[section]
    return section == around


def _around(page: Page, blocks: list[int]) -> int:
    """The smallest section that holds all of the blocks; -1 if only the page does."""
    found = page.section[blocks[0]]
    for b in blocks[1:]:
        other = page.section[b]
        while found != other:
            if found > other:
                found = page.outer[found]
            else:
                other = page.outer[other]
    return found


def main_blocks(page: Page, weights: dict[str, float], default: float = 2.0) -> list[str]:
    start, end = best_region(page, weights, default)
    inside = [b for key, words, b in page.events[start:end] if key is None and words]
    by_element = Counter()
    for b in inside:
        by_element[page.blocks[b][1]] += len(page.blocks[b][0])
    if not by_element:
        return []
    element, most = by_element.most_common(1)[0]
    if element >= 0:
        own = {e for e, n in by_element.items() if e >= 0 and 4 * n >= most}
        return [text for text, of, may in page.blocks if may and of in own]
    around = _around(page, inside)
    if around >= 0:
        return [text for (text, _, may), s in zip(page.blocks, page.section, strict=True) if may and _within(page, s, around)]
    return [page.blocks[b][0] for b in inside]


def main_text(source: str | None, weights: dict[str, float], default: float = 2.0) -> str:
    return "\n".join(main_blocks(Page(source or ""), weights, default))


def learn_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_labelled: int = 500) -> dict[str, float]:
    """Tags' weights from at most max_labelled pages with an article element."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside, outside = Counter(), Counter()
            for source in batch.column(0):
                depth = 0
                for key, _, _ in Page(source.as_py() or "").events:
                    if key is not None:
                        key = key.removeprefix(DOUBT_MARK)
                        name = key.split(".")[0]
                        depth -= name == "/article" and depth > 0
                        (inside if depth and name != "article" else outside)[key] += 1
                        depth += name == "article"
            keys = sorted(inside | outside)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([inside[k] for k in keys], pa.int64()), pa.array([outside[k] for k in keys], pa.int64())], ["key", "inside", "outside"])

    labelled = pages.where(F.col(html_col).contains("<article")).orderBy(F.xxhash64(id_col), id_col).limit(max_labelled)
    counts = labelled.select(html_col).mapInArrow(count, "key string, inside long, outside long").groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    return {r.key: min(40.0, max(0.25, 1 + 2 * math.log((r.outside + 1) / (r.inside + 1)))) for r in counts.collect()}


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_labelled: int = 500, weights: dict[str, float] | None = None) -> DataFrame:
    """pages with their main text instead of the html column: text, n_chars (code points)."""
    learned = pages.sparkSession.sparkContext.broadcast(learn_weights(pages, id_col, html_col, max_labelled) if weights is None else weights)

    @F.pandas_udf("string")
    def text(source):
        return source.map(lambda s: main_text(s if isinstance(s, str) else "", learned.value))

    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    return pages.withColumn("text", text(html_col)).select(*keep, "text").withColumn("n_chars", F.length("text").cast("long"))
