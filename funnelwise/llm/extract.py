"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element, with the length of
its text outside links as the line's weight.  Weights are summed over sliding
windows of ``WINDOW`` lines; where the sums rise to ``SURGE`` a stretch starts,
where they dive to nothing it ends.  Menus, forms, notices, comments and the
like, known by element or by name, are barriers: no window reaches across them
and no stretch holds them.

All stretches in the container of the heaviest one are kept, with the short and
link-only lines around them that lengths alone would lose.  The container is
the article or main element (each of them, where several hold a fifth of the
heaviest stretch); else the smallest element around the stretch, widened while
an element further out holds stretches of another fifth.  Where that is the
page itself, the text runs from the first stretch to the last.

A name marks an element only if all of its parts speak of the page's furniture
(``related-posts``, ``cookie-notice``, not ``related-work``).  Parsing and choice
take time in proportion to the page, however deep its markup.

Defined results: null and empty pages, and pages without text, give the empty
text; unclosed elements end with their parent, but an unclosed barrier ends at
an article or main element; without any stretch the heaviest line stands for
one; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from funnelwise.llm.common import map_batches

WINDOW = 3
SURGE = 60

# HTML elements (fixed values)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
                  "hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style noscript template svg math iframe object canvas textarea title".split())
LEFT_OUT = RAW | frozenset("head nav footer aside form button select option menu dialog audio video label input datalist".split())
MAIN = frozenset("article main".split())
#: Words of class, id and role that mark what isn't the article (fixed values).
MARKED_OUT = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert menu nav navbar "
                       "navigation breadcrumb breadcrumbs sidebar aside widget widgets footer masthead topbar toolbar comment comments reply replies respond disqus share "
                       "sharing social related recommended newsletter subscribe subscription signup login search popup modal overlay pagination pager complementary "
                       "contentinfo dialog tooltip skip".split())
#: Words that may stand beside them in a name (fixed values).
FURNITURE = frozenset("area articles bar block body bottom box button buttons card cards column container content fixed form global group header icons inline inner item items left "
                      "link links list main media message mobile module page panel policy post posts primary reader readers right secondary section site slot sticky stories "
                      "story tags text thread to top unit user wrap wrapper".split())
#: Beginnings and ends of such words (fixed values).
BEGINNINGS = ("advert", "breadcrumb", "commentlist", "comments", "cookie", "newsletter", "sidebar", "sponsor")
ENDS = ("nav", "menu")
#: First parts of names that speak of the layout around (has-sidebar, no-menu; fixed values).
LAYOUT = frozenset("has with without no is layout".split())
#: ... and what holds the article (fixed values).
MARKED_IN = frozenset("article content main post entry story articlebody body text".split())
#: Names with which even an article element isn't the page's article (fixed values).
LESSER = frozenset("comment comments reply related ad ads sponsored promo".split())
#: Elements of running text, which hold no article of their own (fixed values).
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre address figure figcaption table thead tbody tfoot tr th caption hgroup details summary "
                    "a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|[\s\"'])(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


def _names(attributes: str) -> list[list[str]]:
    """The names in class, id, role, itemprop and aria-label, cut into their words."""
    names = (n for m in _NAMES.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").lower().split())
    return [[w for w in _SPLIT.split(n) if w] for n in names]


def _out(word: str) -> bool:
    return word in MARKED_OUT or word.startswith(BEGINNINGS) or word.endswith(ENDS)


def _marked_out(names: list[list[str]], inside: bool) -> bool:
    for parts in names:
        if parts and parts[0] not in LAYOUT and any(map(_out, parts)) and all(_out(w) or w in FURNITURE or w.isdigit() for w in parts):
            return True
    words = {w for parts in names for w in parts}
    return "header" in words and not inside and not words & MARKED_IN


class Lines:
    """The lines of a page and its elements.

    Elements are numbered in page order, so an element's inner ones are those from
    its number to ``last`` of it.  A line has its text, its length outside links,
    its innermost element (-1: none), and whether it stands in a barrier.  Barriers
    of ``ended`` end at the first article or main element inside them."""

    def __init__(self, page: str, ended: frozenset[int] = frozenset()):
        self.texts: list[str] = []
        self.weights: list[int] = []
        self.element: list[int] = []
        self.barred: list[bool] = []
        self.kind: list[str] = []
        self.parent: list[int] = []
        self.last: list[int] = []
        self.mains: list[int] = []  # article and main elements outside barriers
        self.doubtful: dict[int, bool] = {}  # barrier around an article or main element -> has an end tag
        self._parts: list[str] = []
        self._plain = 0
        self._stack: list[tuple[str, int, bool]] = []  # name, number, barrier
        self._open: Counter = Counter()  # names on the stack
        self._barriers: list[int] = []
        self._mains_open = 0
        at, size = 0, len(page)
        while at < size:
            m = _TOKEN.search(page, at)
            text = page[at:m.start() if m else size]
            if text:
                text = html.unescape(text)
                self._parts.append(text)
                if not self._open["a"]:
                    self._plain += len(text.strip())
            if not m:
                break
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:  # an end tag closes all up to its start tag, if that is open
                if self._open[name]:
                    if name in BLOCK:
                        self._end()
                    while self._stack[-1][0] != name:
                        self._pop()
                    if self._stack[-1][1] in self.doubtful:
                        self.doubtful[self._stack[-1][1]] = True
                    self._pop()
                continue
            if name in RAW and not m[3].rstrip().endswith("/"):  # no markup inside
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else size
                continue
            if name in BLOCK:
                self._end()
                if name != "br" and self._stack and self._stack[-1][0] == "p":
                    self._pop()
            if name in VOID or m[3].endswith("/"):
                continue
            self._start(name, m[3], ended)
        self._end()
        while self._stack:
            self._pop()

    def _start(self, name: str, attributes: str, ended: frozenset[int]) -> None:
        names, inside = _names(attributes), self._mains_open > 0
        lesser = any(w in LESSER for parts in names for w in parts)
        if name in MAIN and self._barriers and not lesser:
            while self._barriers and self._barriers[0] in ended:
                self._pop()
            for b in self._barriers:
                self.doubtful.setdefault(b, False)
        barrier = name in LEFT_OUT or name == "header" and not inside or bool(_HIDDEN.search(attributes)) or name not in ("html", "body") and _marked_out(names, inside)
        if name in MAIN:
            barrier = barrier and lesser
        number = len(self.kind)
        self.kind.append(name)
        self.parent.append(self._stack[-1][1] if self._stack else -1)
        self.last.append(number)
        if barrier:
            self._barriers.append(number)
        elif name in MAIN and not self._barriers:
            self.mains.append(number)
        self._mains_open += name in MAIN and not barrier
        self._stack.append((name, number, barrier))
        self._open[name] += 1

    def _pop(self) -> None:
        name, number, barrier = self._stack.pop()
        self._open[name] -= 1
        self.last[number] = len(self.kind) - 1
        if barrier:
            self._barriers.pop()
        self._mains_open -= name in MAIN and not barrier

    def _end(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.texts.append(text)
                self.weights.append(self._plain)
                self.element.append(self._stack[-1][1] if self._stack else -1)
                self.barred.append(bool(self._barriers))
            self._parts.clear()
        self._plain = 0

    def holds(self, element: int, line: int) -> bool:
        return element < 0 or element <= self.element[line] <= self.last[element]

    def around(self, first: int, last: int) -> int:
        """The smallest element that holds both lines and isn't running text (-1: none)."""
        low, high = sorted((self.element[first], self.element[last]))
        while low >= 0 and (self.last[low] < high or self.kind[low] in RUNNING):
            low = self.parent[low]
        return low


def parse(page: str) -> Lines:
    """The lines; an unclosed barrier around an article ends there, and so does a closed one if
    no other article or main element is on the page."""
    lines = Lines(page)
    ended = frozenset(b for b, closed in lines.doubtful.items() if not closed or not lines.mains and lines.kind[b] not in LEFT_OUT)
    return Lines(page, ended) if ended else lines


def stretches(weights: list[int], barred: list[bool]) -> list[tuple[int, int]]:
    """First and last line of each stretch between a surge and a dive; none holds a barred line."""
    found, i, n = [], 0, len(weights)
    sums = [0] * (n + 1)
    for k in range(n - 1, -1, -1):  # of the lines up to the next barrier, at most WINDOW
        if not barred[k]:
            for w in range(k, min(n, k + WINDOW)):
                if barred[w]:
                    break
                sums[k] += weights[w]
    while i < n:
        if sums[i] < SURGE:
            i += 1
            continue
        start = i
        while i + 1 < n and sums[i + 1] > 0:
            i += 1
        end = i
        i += 1
        while not weights[start]:
            start += 1
        while not weights[end]:
            end -= 1
        found.append((start, end))
    return found


def _containers(lines: Lines, found: list[tuple[int, int]]) -> list[int]:
    """The elements that hold the article, -1 for the page itself."""
    held = [0] * (len(lines.kind) + 1)  # weight of the stretches before an element, in page order
    for start, end in found:
        for k in range(start, end + 1):
            held[lines.element[k] + 1] += max(lines.weights[k], 1)
    total = list(accumulate(held))

    def weight(element: int) -> int:
        return total[lines.last[element] + 1] - total[element]

    heaviest = max(found, key=lambda s: (sum(lines.weights[s[0]:s[1] + 1]), -s[0]))
    most = sum(max(w, 1) for w in lines.weights[heaviest[0]:heaviest[1] + 1])
    chosen: list[int] = []
    outer = -1  # last element of the outermost one at hand
    for e in lines.mains:
        if e > outer:
            outer = lines.last[e]
            if 5 * weight(e) >= most:
                chosen.append(e)
        elif chosen and chosen[-1] < e <= lines.last[chosen[-1]] and weight(e) == weight(chosen[-1]):
            chosen[-1] = e  # nothing of a stretch is outside the inner one
    if chosen:
        return chosen
    here = lines.around(*heaviest)
    up = here
    while up >= 0:
        up = lines.parent[up]
        if here >= 0 and 5 * ((weight(up) if up >= 0 else total[-1]) - weight(here)) >= most:
            here = up
    return [here]


def main_text(page: str | None) -> str:
    """The article's text: blocks in page order, joined by one space."""
    lines = parse(page or "")
    open_lines = [k for k, barred in enumerate(lines.barred) if not barred]
    if not open_lines:
        return ""
    found = stretches(lines.weights, lines.barred)
    if not found:
        mains = [k for k in open_lines if any(lines.holds(e, k) for e in lines.mains[:1])]
        k = max(mains or open_lines, key=lambda k: (lines.weights[k], len(lines.texts[k]), -k))
        found = [(k, k)]
    kept: set[int] = set()
    for element in _containers(lines, found):
        if element >= 0 and lines.kind[element] not in ("html", "body"):
            kept.update(k for k in open_lines if lines.holds(element, k))
            kept.update(k for start, end in found for k in range(start, end + 1) if lines.holds(element, k))
        else:
            first, last = found[0][0], found[-1][1]
            while first and not lines.barred[first - 1] and lines.kind[lines.element[first - 1]] in ("h1", "h2", "h3") and lines.element[first - 1] >= 0:
                first -= 1
            kept.update(k for k in open_lines if first <= k <= last)
            kept.update(k for start, end in found for k in range(start, end + 1))
    return " ".join(lines.texts[k] for k in sorted(kept))


def extract(pages: DataFrame) -> DataFrame:
    """The contract's rows: page_id, url, text, n_chars."""
    def run(batch: pa.RecordBatch) -> dict:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_batches(rows, run, "page_id bigint, url string, text string, n_chars bigint")
