"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its root-to-leaf path of block
elements.  For each path the text length and the punctuation of its blocks are
aggregated and divided by the number of its blocks; links count against it.
Both ratios are smoothed along the page and fused into one score for each path.
The paths at or over ``THRESHOLD`` of the best score are the article's.

Everything else only weighs on the scores.  Elements that may hold the article
(by tag, role or class) raise those of the paths in them, names that tell of
adverts, notices, sidebars or comments lower them, and so does the shape of a
comment list: alike units, without headings, each with an author, a time or a way
to reply.  Paths with different weights are aggregated apart.  Only elements
that HTML itself sets apart (menus, asides, footers, dialogs, what is hidden, and
forms that don't hold most of the page) have no score at all.

Short blocks are filled in.  Where marked elements hold the better part of the
selected text, the article is what they hold, but for paths made of links and for
lowered paths under the threshold, and other marked elements with hardly any text
are left.  Where no element is marked, what lies between the selected paths under
the same parents is filled in.

A page is read in time and memory in proportion to its size: elements beyond
``DEPTH`` levels become siblings of the last one, as browsers have it; behind the
last ``>`` there is no tag; and where ``BROKEN`` tags have no end outside of quotes,
quotes no longer count.

Edge cases: null or empty html, or a page without content, gives an empty text;
unclosed elements, comments and scripts end with the page; paths that tie are
selected alike; ids and urls are returned as they are, rows may repeat, and other
columns of whatever name are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed vocabularies.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object audio video canvas select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that never hold the article.
OUTSIDE = frozenset("head nav footer aside button menu dialog fieldset input datalist".split())
#: Roles that never hold it.
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar status".split())
#: Words in class or id that tell of what surrounds an article.
OUTSIDE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot banner banners breadcrumb breadcrumbs comment comments commentlist
    consent cookie cookies copyright disqus footer foot gdpr login masthead menu menus modal nav navbar navigation newsletter
    notification overlay pager pagination paywall popup popover promo promos promoted promotion recommendations
    remark remarks replies respond share sharing shares sidebar signin signup skip skiplink social sponsor sponsored sponsors subscribe
    subscription tagcloud toolbar tooltip topbar widget widgets""".split()
)
#: Words that may tell of it or be the article's own.
DOUBTFUL_WORDS = frozenset("alert alerts aside discussion feedback header notice notices reactions recommend recommended related reply responses search side".split())
#: Words in class or id that mark an article.
INSIDE_WORDS = frozenset("article articlebody content contents entry main maincontent post postbody body story text page-content articlecontent".split())
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
PUNCTUATION = re.compile(r"[,.;:!?…。，、！？；：]")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
#: The same where quotes don't count; the groups keep their numbers.
UNQUOTED = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|(?!)()()()", re.S)
#: Tags without an end outside of quotes after which a page's quotes no longer count, and most levels of elements.
BROKEN, DEPTH = 16, 256
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Names that tell what a layout has or lacks ("no-sidebar") rather than what it is.
STATE = re.compile(r"(?i)(?:no|has|with|without|is|hide|show)[-_]")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACES = re.compile(r"\s+")
HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
CLASS = re.compile(r"""(?i)(?:^|\s)class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Elements that units of a list are made of.
UNIT_TAGS = frozenset("li div article section blockquote dd tr".split())
#: Elements and attributes that tell of an author, of a time, or of a way to reply.
SIGNING = frozenset("time cite".split())
SIGNED = re.compile(r"(?i)author|avatar|user|nick|posted|permalink|\breply|upvote|#comment|\bago\b|/Comment\b")

#: Share of the best path's score that a path needs.
THRESHOLD = 0.35
#: What an element's mark multiplies the scores of the paths in it by.
BONUS = (1.0, 1.5, 2.0)
#: What names multiply them by, outside of marked elements and within: telling ones, doubtful ones.
NAMED = ((0.1, 0.2), (0.3, 0.7))
#: What the shape of a comment list multiplies them by.
UNITS = 0.2
#: Share of the selected text that marked elements need, and share of the richest one's that each of them needs.
MOST, SOME = 0.6, 0.15
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Weights of the smoothing along the page.
KERNEL = (0.25, 0.5, 0.25)


def _mark(tag: str, attributes: str, inside: bool) -> tuple[int, float]:
    """A mark and a weight.  -1: outside the article; 1: may hold it; 2: is marked as holding it; 0: neither.  ``inside``: within an element of mark 2."""
    if tag in OUTSIDE or tag == "header" and not inside:
        return -1, 1.0
    mark, weight = 2 if tag in ("article", "main") else 0, 1.0
    if not attributes:
        return mark, weight
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role":
            if value.lower() in OUTSIDE_ROLES:
                return -1, 1.0
            mark = max(mark, 2 * (value.lower() in ("main", "article")))
        elif name == "itemprop" and value.lower() in ("articlebody", "comment"):
            mark, weight = (2, weight) if value.lower() == "articlebody" else (mark, NAMED[0][inside])
        elif name in ("class", "id") and tag not in ("html", "body"):
            own = {w.lower() for x in value.split() if not STATE.match(x) for w in (x, *WORDS.findall(x))}
            for kind, words in enumerate((OUTSIDE_WORDS, DOUBTFUL_WORDS)):
                if own & words:
                    weight = min(weight, NAMED[kind][inside])
            if own & INSIDE_WORDS:
                mark = max(mark, 1)
        elif name in ("hidden", "aria-hidden") and value.lower() in ("true", "hidden", "") or name == "style" and HIDDEN.search(value):
            return -1, 1.0
    if re.search(r"(?:^|\s)hidden(?:\s|$)", ATTRIBUTE.sub("", attributes)):
        return -1, 1.0
    return (0 if weight < 1 and mark == 1 else mark), weight


class Block:
    __slots__ = ("path", "marks", "line", "weight", "parts", "links", "text")

    def __init__(self, path: tuple, marks: tuple, line: tuple, weight: float) -> None:
        self.path, self.marks, self.line, self.weight, self.parts, self.links, self.text = path, marks, line, weight, [], 0, ""

    @property
    def key(self) -> tuple:
        return self.path, self.weight


class Elements:
    """What is known of each element of a page, by number: parent, tag with class, and what it holds."""

    HEADING, SIGNED = 1, 2

    def __init__(self) -> None:
        self.parent, self.kind, self.holds = [0], [("", "")], [0]

    def add(self, parent: int, tag: str, attributes: str) -> int:
        named = CLASS.search(attributes)
        self.parent.append(parent)
        self.kind.append((tag, (named[1] or named[2] or named[3] or "") if named else ""))
        self.holds.append(self.HEADING * (tag in HEADINGS))
        return len(self.parent) - 1

    def lists(self) -> set[int]:
        """Elements that hold at least two alike units, most of them signed and none with a heading."""
        for n in range(len(self.parent) - 1, 0, -1):
            self.holds[self.parent[n]] |= self.holds[n]
        units: dict[tuple, list[int]] = {}
        for n in range(1, len(self.parent)):
            if self.kind[n][0] in UNIT_TAGS:
                # Numbers and states in a class don't make units unlike.
                units.setdefault((self.parent[n], self.kind[n][0], *self.kind[n][1].split()[:1]), []).append(n)
        found = set()
        for own in units.values():
            signed = sum(self.holds[n] & self.SIGNED > 0 for n in own)
            if len(own) > 1 and 2 * signed > len(own) and not any(self.holds[n] & self.HEADING for n in own):
                found.update(own)
        return found


def cut(page: str) -> tuple[list[Block], Elements]:
    """Blocks of a page outside of what never holds the article, in page order, and the page's elements."""
    stack: list[tuple[str, int, int, float]] = []  # (tag, mark, number of the element, weight)
    elements = Elements()
    blocks: list[Block] = []
    now: Block | None = None
    dropped = links = marked = at = broken = 0
    open_: dict[str, int] = {}
    # Of each level: path, marks, line of elements and weight of what stands in it; alike paths are one object.
    frames: list[tuple[tuple, tuple, tuple, float]] = [((), (), (), 1.0)]
    paths: dict[tuple, tuple] = {}

    def pop() -> None:
        nonlocal dropped, marked
        tag, mark, _, _ = stack.pop()
        frames.pop()
        open_[tag] -= 1
        dropped -= mark < 0
        marked -= mark == 2

    def add(text: str) -> None:
        nonlocal now
        if dropped or not text:
            return
        if now is None:
            if text.isspace():
                return
            now = Block(*frames[-1])
            blocks.append(now)
        now.parts.append(text)
        if links:
            now.links += len(text)

    # No tag ends behind the last ">", so none is looked for there.
    last = page.rfind(">") + 1
    while m := (TOKEN if broken < BROKEN else UNQUOTED).search(page, at, last):
        add(page[at : m.start()])
        at = m.end()
        broken += m[5] is not None
        if at == last and m[0].startswith("<!--") and not m[0].endswith("-->"):
            at = len(page)
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        attributes = m[3] or m[6] or ""
        if not closing and stack and (tag in SIGNING or attributes and SIGNED.search(attributes)):
            elements.holds[stack[-1][2]] |= Elements.SIGNED
        if tag in RAW:
            now = None if tag in ("script", "style", "noscript", "template", "title") and now is None else now
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at, last)
                at = end.end() if end else len(page)
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if closing else 1))
            elif tag == "br":
                add(" ")
            continue
        now, links = None, 0
        if tag in VOID:
            continue
        if closing:
            if open_.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        # What an opening element closes by itself.
        if stack and stack[-1][0] in CLOSED_BY_BLOCK:
            pop()
        for same in ({"li"}, {"dt", "dd"}, {"tr"}, {"td", "th"}, {"option"}):
            if tag in same and stack and stack[-1][0] in same:
                pop()
        if tag == "body":
            while stack and stack[-1][0] == "head":
                pop()
        if attributes.endswith("/"):
            continue
        while len(stack) >= DEPTH:
            pop()
        mark, weight = _mark(tag, attributes, marked > 0)
        number = elements.add(stack[-1][2] if stack else 0, tag, attributes)
        if attributes and SIGNED.search(attributes):
            elements.holds[number] |= Elements.SIGNED
        stack.append((tag, mark, number, weight))
        open_[tag] = open_.get(tag, 0) + 1
        path, marks, line, least = frames[-1]
        path += (tag,)
        frames.append((paths.setdefault(path, path), marks + ((mark, number),) if mark > 0 else marks, line + (number,), min(least, weight)))
        dropped += mark < 0
        marked += mark == 2
    rest = page.find("<!--", max(at, last))  # a comment that nothing ends
    add(page[at:] if rest < 0 else page[at:rest])
    for b in blocks:
        b.text = SPACES.sub(" ", entities.unescape("".join(b.parts))).strip()
    return [b for b in blocks if b.text], elements


def path_scores(blocks: list[Block]) -> dict[tuple, float]:
    """Fused, smoothed ratio of each path (with its weight, which isn't applied here)."""
    length: dict[tuple, float] = {}
    points: dict[tuple, float] = {}
    count: dict[tuple, int] = {}
    for b in blocks:
        own = max(0.0, len(b.text) - 1.5 * b.links)
        length[b.key] = length.get(b.key, 0) + own
        points[b.key] = points.get(b.key, 0) + len(PUNCTUATION.findall(b.text)) * (own > 0)
        count[b.key] = count.get(b.key, 0) + 1
    ratio = [(math.log1p(length[b.key] / count[b.key]), math.log1p(points[b.key] / count[b.key])) for b in blocks]
    total: dict[tuple, float] = {}
    for i, b in enumerate(blocks):
        near = [ratio[min(max(i + d, 0), len(ratio) - 1)] for d in (-1, 0, 1)]
        text, marks = (sum(w * r[k] for w, r in zip(KERNEL, near)) for k in (0, 1))
        total[b.key] = total.get(b.key, 0) + text * (1 + marks)
    return {p: v / count[p] for p, v in total.items()}


def without_forms(blocks: list[Block]) -> list[Block]:
    """Drops the blocks of each form that doesn't hold half of the page's score."""
    if not any("form" in b.path for b in blocks):
        return blocks
    score = path_scores(blocks)
    whole, held = 0.0, {}
    for b in blocks:
        own = score[b.key] * b.weight * len(b.text)
        whole += own
        for tag, n in zip(b.path, b.line):
            if tag == "form":
                held[n] = held.get(n, 0) + own
    minor = {n for n, v in held.items() if v < 0.5 * whole}
    return [b for b in blocks if minor.isdisjoint(b.line)]


def _shared_element(lines: list[tuple], tags: tuple) -> int | None:
    """The innermost element that holds all of some elements (each as the line of numbers above it), unless it is the page."""
    depth = 0
    while all(len(x) > depth and x[depth] == lines[0][depth] for x in lines):
        depth += 1
    return lines[0][depth - 1] if depth and tags[depth - 1] not in ("html", "body") else None


def main_text(page: str | None) -> str:
    blocks, elements = cut(page or "")
    blocks = without_forms(blocks)
    if not blocks:
        return ""
    units = elements.lists()
    for b in blocks:
        b.weight *= 1.0 if units.isdisjoint(b.line) else UNITS
    plain = path_scores(blocks)
    mass = [plain[b.key] * b.weight * len(b.text) for b in blocks]
    held: dict[int, float] = {}
    for b, own in zip(blocks, mass):
        for _, n in b.marks:
            held[n] = held.get(n, 0) + own
    # A mere word in a class is weaker evidence than text: its element must hold most of the page's score.
    half = 0.5 * sum(mass)
    marks = [[(m, n) for m, n in b.marks if m == 2 or held[n] >= half] for b in blocks]
    score = [plain[b.key] * b.weight * BONUS[max((m for m, _ in own), default=0)] for b, own in zip(blocks, marks)]
    limit = THRESHOLD * max(score)
    good = [i for i, v in enumerate(score) if v >= limit]
    keep = set(good)
    top = max((m for i in good for m, _ in marks[i]), default=0)
    if top:
        chosen = {next(n for m, n in marks[i] if m == top) for i in good if any(m == top for m, _ in marks[i])}
        richest = max(held[n] for n in chosen)
        chosen = {n for n in chosen if held[n] >= SOME * richest}
        if len(chosen) > 1:
            holding: dict[int, Block] = {}
            for b in blocks:
                for n in chosen.intersection(b.line):
                    holding.setdefault(n, b)
            around = _shared_element([b.line[: b.line.index(n)] for n, b in holding.items()], next(iter(holding.values())).path)
            chosen |= {around} if around else set()
        length: dict[tuple, int] = {}
        links: dict[tuple, int] = {}
        for b in blocks:
            length[b.key] = length.get(b.key, 0) + len(b.text)
            links[b.key] = links.get(b.key, 0) + b.links
        inside = {i for i, b in enumerate(blocks) if not chosen.isdisjoint(b.line)}
        if sum(mass[i] for i in good if i in inside) >= MOST * sum(mass[i] for i in good):
            keep &= inside
        keep |= {i for i in inside if blocks[i].weight == 1 and (2 * links[blocks[i].key] <= length[blocks[i].key] or blocks[i].path[-1:] and blocks[i].path[-1] in HEADINGS)}
    else:
        parents = {blocks[i].path[:-1] for i in good}
        least = min(blocks[i].weight for i in good)
        keep |= {i for i in range(max(good[0] - 1, 0), good[-1] + 1) if blocks[i].path[:-1] in parents and blocks[i].weight >= least}
    return "\n".join(blocks[i].text for i in sorted(keep))


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            texts = [main_text(h) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return own.mapInArrow(_extractor, "page_id long, url string, text string, n_chars long")
