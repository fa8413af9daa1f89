"""Main text of web pages by line-block distribution.

Markup is stripped first: comments, scripts, styles and the head go, and so do menus, headers, footers, sidebars, notices, adverts,
forms and reader comments, known by their element, their role, or a class or id word that says only that. In an article a single word
that may also name what it is about (a section called discussion, a table called menu) counts only if the part is mostly links. Each block
element is a line. The lengths of text outside links are then summed over windows of ``WINDOW`` lines. A surge is the first line
of a run of windows with text, a dive the line where the sums fall back to zero; a run counts if some window in it reaches
``SURGE`` characters, or a tenth of the page's fullest window if that is less. The text between surge and dive is kept, all
its lines.

Lines in article and main elements are taken together, links too, if they hold at least as much text as the largest run of the
lines outside; then the windows run over them alone and any text is a surge. If they hold less, or there are none, the
windows run over the lines outside. A page with no text but links is kept as it is.

Character references are decoded, white space inside a line becomes one space, lines are trimmed and empty ones go.

Defined results: null and empty pages, and pages without text, give an empty text; unclosed elements end where their
parent does, an unclosed head at the first element or text that belongs to a body, an unclosed script or comment at the page's end;
an end tag without a start is a line break at most; very long pages take linear time; rows are independent, so repeated rows give
equal results and an empty table an empty one; other columns don't matter.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW, SURGE = 3, 80

# Element names of the HTML standard, and words that page authors give to the parts that go.
RAW = frozenset("iframe noscript script style textarea title".split())  # hold no markup
UNSEEN = RAW | frozenset("head select template".split())
METADATA = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
FOREIGN = frozenset(("svg", "math"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "p pre section summary table tbody td tfoot th thead tr ul".split()
)
AROUND = frozenset("nav aside footer form menu button dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo banner breadcrumb breadcrumbs nav navbar navigation menu masthead topbar sidebar sidenav "
    "notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login form comment comments commentlist discussion disqus replies header footer".split()
)
TOPICS = frozenset("banner cookie cookies discussion menu notice notices overlay promo replies".split())  # words that also name what an article is about
BEFORE = frozenset("site page global main top bottom left right primary secondary user reader header footer side".split())
BEHIND = frozenset("area bar block bottom box container inner item items left links list section slot top unit wrap wrapper".split())
NAMED_ELEMENTS = frozenset("article aside center dd details div dl dt figure footer header iframe ins li main menu nav ol p section span table tbody td th tr ul".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_MARK = re.compile(r"[>\"']")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE) for name in RAW}
_NAMED = re.compile(r"""\b(class|id|role)\b\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_SPACE = re.compile(r"\s+")


def says_around(word: str, inside: bool) -> bool:
    """Whether a class or id word names a part that goes, and nothing else: words of WORDS, perhaps with a place before or a kind behind them."""
    parts = [p.lower() for p in _PART.findall(word) if not p.isdigit()]
    while parts and parts[-1] in BEHIND:
        parts.pop()
    own = [p for p in parts if p in WORDS]
    if inside and set(own) <= {"header"}:  # an article's own header belongs to it
        return False
    while parts and parts[0] in BEFORE and parts[1:]:
        parts.pop(0)
    return bool(own) and all(p in WORDS for p in parts)


def may_be_topic(word: str) -> bool:
    """Whether a class or id word is a single word that may as well name a part of an article."""
    parts = _PART.findall(word)
    return len(parts) == 1 and parts[0].lower() in TOPICS


def around(name: str, attrs: str, inside: bool) -> bool:
    """Whether an element holds what is around an article; inside: it is in an article or main element."""
    if name in AROUND and not (inside and name == "fieldset") or (name == "header" and not inside):
        return True
    if not attrs or name not in NAMED_ELEMENTS or name in ("article", "main") and not inside:
        return False
    for key, a, b, c in _NAMED.findall(attrs):
        value = a or b or c
        if key.lower() == "role":
            if value.strip().lower() in ROLES:
                return True
        elif any(says_around(word, inside) and not (inside and may_be_topic(word)) for word in value.split()):
            return True
    return False


def doubtful(name: str, attrs: str) -> bool:
    """Whether an element of an article has a name that only its text can confirm."""
    return bool(attrs) and name in NAMED_ELEMENTS and any(may_be_topic(word) for key, a, b, c in _NAMED.findall(attrs) if key.lower() != "role" for word in (a or b or c).split())


class Scanner:
    """The tags of a page, front to back, in linear time.

    A tag ends at the first ``>`` outside quotes, or at the first one at all if no ``>`` follows outside quotes or a quote isn't
    closed. What would be looked for in vain is remembered: the last ``>`` and the last quotes of the page, and the
    quotes behind which no tag ends.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "<>\"'"}
        self.lost: set[int] = set()

    def _end(self, at: int) -> int:
        """Behind the ``>`` of a tag whose attributes start at ``at``; there is one."""
        page, first, opened = self.page, 0, []
        i = at
        while True:
            m = _MARK.search(page, i)
            if not m:
                break
            k, c = m.start(), m[0]
            if c == ">":
                return k + 1
            if k in self.lost or k >= self.last[c]:
                break
            opened.append(k)
            i = page.find(c, k + 1) + 1
            if i > self.last[">"]:
                break
        self.lost.update(opened)
        first = page.find(">", at)
        return first + 1

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name or nothing, whether it is an end tag, attributes) of the next tag, comment or declaration."""
        page, last = self.page, self.last[">"]
        while 0 <= (k := page.find("<", at) if at <= self.last["<"] else -1):
            if page.startswith("<!--", k):
                end = page.find("-->", k + 4)
                return k, end + 3 if end >= 0 else len(page), "", False, ""
            if page[k : k + 9].upper() == "<![CDATA[":
                end = page.find("]]>", k + 9)
                return k, end + 3 if end >= 0 else len(page), "", False, ""
            if k < last:
                if page[k + 1] in "!?":
                    return k, page.find(">", k + 2) + 1, "", False, ""
                if m := _NAME.match(page, k):
                    e = m.end()
                    if page[e] in "/>" or page[e].isspace():
                        end = self._end(e)
                    else:
                        end = page.find(">", e) + 1
                    return k, end, m[2].lower(), bool(m[1]), page[e : end - 1]
            at = k + 1
        return None


def lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters outside links but for white space, in an article or main element) of each line."""
    out: list[tuple[str, int, bool, int]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # open elements: name, hides, holds an article, begins a doubtful part
    opened: Counter[str] = Counter()
    endless: set[str] = set()  # raw elements without a further end tag
    hidden = articles = plain = parts = doubt = 0
    buffer: list[str] = []

    def flush() -> None:
        nonlocal plain
        text = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
        buffer.clear()
        if text:
            out.append((text, plain, articles > 0, doubt))
        plain = 0

    def close(upto: int) -> None:
        nonlocal hidden, articles, doubt
        while len(stack) > upto:
            name, hides, holds, begins = stack.pop()
            opened[name] -= 1
            if not hidden and (holds or begins or name in BLOCKS):
                flush()
            if begins:
                doubt = 0
            articles -= holds
            hidden -= hides

    def place(name: str) -> int:
        """Of the innermost open element so called."""
        return next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)

    def leave_head() -> None:
        """End a head that only unclosed titles and the like keep open."""
        k = len(stack) - 1
        while k >= 0 and stack[k][0] in RAW:
            k -= 1
        if k >= 0 and stack[k][0] == "head":
            close(k)

    at, scanner = 0, Scanner(page)
    while tag := scanner.next(at):
        start, end, name, ends_one, attrs = tag
        if hidden and stack[-1][0] == "head" and page[at:start].strip():
            close(len(stack) - 1)
        if not hidden and start > at:
            text = page[at:start]
            buffer.append(text)
            if not opened["a"]:
                plain += len(_SPACE.sub("", html.unescape(text)))
        at = end
        if not name:
            continue
        if ends_one:
            if name in BLOCKS and not hidden:
                flush()
            if opened[name]:
                close(place(name))
            continue
        if hidden and opened["head"]:
            if name == "body":
                close(place("head"))
            elif name not in METADATA:
                leave_head()
        if name == "br":
            buffer.append(" ")
            continue
        if name in VOID:
            if name == "hr" and not hidden:
                flush()
            continue
        closed = attrs.endswith("/") and (name in FOREIGN or opened["svg"] or opened["math"])
        if name in RAW and name not in endless and not closed:
            if ends := _RAW_END[name].search(page, at, scanner.last[">"] + 1):
                at = ends.end()
                continue
            if name == "script":
                at = len(page)
                break
            endless.add(name)
        if closed:
            continue
        if name in ("p", "li") and stack and stack[-1][0] == name:
            close(len(stack) - 1)
        hides = name in UNSEEN or around(name, attrs, articles > 0)
        if not hidden and name in BLOCKS:
            flush()
        holds = name in ("article", "main") and not hides and not hidden
        begins = articles > 0 and not hidden and not hides and not doubt and doubtful(name, attrs)
        if begins:
            flush()
            parts += 1
            doubt = parts
        articles += holds
        hidden += hides
        stack.append((name, hides, holds, begins))
        opened[name] += 1
    if hidden and stack[-1][0] == "head" and page[at:].strip():
        close(len(stack) - 1)
    if not hidden and at < len(page):
        buffer.append(page[at:])
        plain += 0 if opened["a"] else len(_SPACE.sub("", html.unescape(page[at:])))
    flush()
    # a doubtful part goes if it is mostly links
    whole, own = Counter(), Counter()
    for text, n, _, part in out:
        if part:
            whole[part] += len(text.replace(" ", ""))
            own[part] += n
    return [x[:3] for x in out if not x[3] or own[x[3]] * 2 > whole[x[3]]]


def ranges(weights: list[int], surge: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """(surge, dive) of each run of lines that the window sums hold together and in which one reaches ``surge``."""
    out, start, last, risen, total = [], None, 0, False, 0
    for i in range(len(weights) + window):  # total: lines i - window + 1 .. i
        new = weights[i] if i < len(weights) else 0
        total += new - (weights[i - window] if i >= window else 0)
        if new:
            start, last = i if start is None else start, i
        risen |= total >= surge
        if not total and start is not None:
            if risen:
                out.append((start, last + 1))
            start, risen = None, False
    return out


def fullest(weights: list[int], window: int = WINDOW) -> int:
    """The largest sum of ``window`` lines."""
    sums = [0, *accumulate(weights)]
    return max((sums[min(i + window, len(weights))] - sums[i] for i in range(len(weights))), default=0)


def extract(page: str | None) -> str:
    """The main text, one block a line."""
    rows = lines(page) if page else []
    inside = [len(t) if held else 0 for t, _, held in rows]
    weights = [0 if held else plain for _, plain, held in rows]
    found = ranges(weights, max(1, min(SURGE, fullest(weights) // 10)))
    outside = max((sum(weights[a:b]) for a, b in found), default=0)
    held = any(inside) and sum(plain for _, plain, held in rows if held) >= outside
    if held:
        found = ranges(inside, 1)
    elif not found:
        found = ranges([len(t) for t, _, _ in rows], 1)
    return "\n".join(t for a, b in found for t, _, inner in rows[a:b] if inner == held)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
