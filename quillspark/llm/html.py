"""Main text of HTML pages by the distribution of text over lines.

Markup is stripped into lines, one per block. Lines under elements for menus, forms and the like are left out before
anything is counted, and lines that are links alone weigh nothing. Names of classes and ids only suggest: what they mark
goes if the lines without marks surge by themselves, and never if it holds the title, the main element or an article. Text lengths are summed over a sliding window of lines; where
the sum rises over the threshold a region surges, where it falls to nothing it dives. A region reaches from dive to
dive, so the short lines that lead it belong to it. All that lies between the start of the first region and the end of
the last is kept. Lines inside an article or main element have a bonus: they weigh twice their length, also when they are
links, and if the regions with such lines hold most of the weight, only these count as first and last.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
THRESHOLD = 86
BONUS = 2
_OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
_QUOTED = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
#: A comment that is closed at once, and the ends of others.
_NO_COMMENT, _COMMENT_END = re.compile(r"<!---?>"), re.compile(r"--!?>")
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Their content is not markup.
_RAW = {"script", "style", "textarea", "noscript", "template", "iframe", "svg", "math", "object"}
#: Without an end tag they reach to the end of the page.
_TO_THE_END = {"script", "style", "textarea"}
_DROPPED = _RAW | {"head", "nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "audio", "video", "canvas"}
_BLOCKS = set("address article blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul aside head title".split())
_CELLS = {"br", "td", "th", "option", "wbr", "img"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role names that mark what is not the article.
_MARKS = set("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead comment comments disqus respond share sharing social related recommended widget complementary contentinfo search alert dialog skip pagination pager toolbar login signup".split())
_MAIN = {"article", "main"}
#: Elements that their names do not put aside, and single paragraphs.
_UNMARKED, _PARAGRAPHS = {"html", "body", "article", "main"}, {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "td"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Inline elements; open ones are not followed.
_FORMATTING = set("a abbr b big cite code em font i kbd label mark nobr q s small span strike strong sub sup tt u var".split())
#: Elements beyond which an end tag ends nothing.
_SCOPES = ("table", "td", "th", "caption")
_LISTS = (*_SCOPES, "ul", "ol", "menu")
_TABLE = {"table", "thead", "tbody", "tfoot", "tr", "td", "th"}
_INSIDE_P = {"td", "th", "tr", "thead", "tbody", "tfoot", "body", "html", "head", "title"}
_IN_HEAD = {"html", "head", "title", "meta", "link", "base", "style", "script", "noscript", "template"}
#: Start tags that end elements whose end tag may be left out: (these, unless one of those is between).
_IMPLIED = {
    "li": (("li",), _LISTS),
    **dict.fromkeys(("dt", "dd"), (("dt", "dd"), (*_SCOPES, "dl"))),
    **dict.fromkeys(("td", "th"), (("td", "th"), ("table",))),
    "tr": (("tr",), ("table",)),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (("thead", "tbody", "tfoot"), ("table",))),
    **dict.fromkeys(("option", "optgroup"), (("option",), ("select",))),
}
_WORD = re.compile(r"\w")


def _marked(attributes: str, element: str) -> int:
    """2 if a name of the element begins with a word that marks what is not the article, 1 if it only contains one, else 0.

    Of a single paragraph only a class counts, and only if it has no other words.
    """
    found = 0
    for m in _NAMES.finditer(attributes):
        if element in _PARAGRAPHS and m[1].lower() == "id":
            continue
        for name in (m[2] or m[3] or m[4] or "").split():
            words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
            if element in _PARAGRAPHS and not _MARKS.issuperset(words):
                continue
            if _MARKS & set(words):
                found = max(found, 2 if words[0] in _MARKS else 1)
    return found


class _Group:
    """An element that is marked by its names: how much text it holds, and what speaks for it."""

    def __init__(self, strong: bool, outer: _Group | None):
        self.strong, self.outer, self.size, self.owns_title = strong, outer, 0, False

    def enclosing(self) -> Iterator[_Group]:
        group: _Group | None = self
        while group is not None:
            yield group
            group = group.outer


class _Open(list):
    """Names of the open elements, and of each name its places; elements whose end tag is left out end as in HTML."""

    def __init__(self) -> None:
        super().__init__()
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, name: str) -> None:
        self.places.setdefault(name, []).append(len(self))
        if name in _BLOCKS or name in _DROPPED or name in _CELLS:
            self.blocks.append(len(self))
        self.append(name)

    def cut(self, k: int) -> None:
        """Ends the element at place k and all inside it."""
        while len(self) > k:
            self.places[self.pop()].pop()
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()

    def nearest(self, names: Iterable[str]) -> int:
        return max((p[-1] for n in names if (p := self.places.get(n))), default=-1)

    def ended_by(self, name: str, dropped: int) -> int:
        """Place of the element that an end tag ends, or -1: a stray end tag ends nothing."""
        if name in ("body", "html"):
            return -1
        k = self.nearest(_HEADINGS if name in _HEADINGS else (name,))
        if k < 0 or k == dropped or name in _TABLE:
            return k if k > self.nearest(("table",)) or name == "table" or k < 0 else -1
        if name in _FORMATTING or name in _BLOCKS or name in _DROPPED:
            return k if k > self.nearest(_LISTS if name == "li" else _SCOPES) else -1
        return k if not self.blocks or k > self.blocks[-1] else -1

    def implied_by(self, name: str) -> int:
        """Place of the element that a start tag ends, or -1."""
        found = -1
        if name in _IMPLIED:
            ended, inside = _IMPLIED[name]
            k = self.nearest(ended)
            found = k if k > self.nearest(inside) else -1
        if name in _BLOCKS and name not in _INSIDE_P or name in ("menu", "dialog"):
            k = self.nearest(("p",))
            if k > self.nearest(_SCOPES):
                found = k if found < 0 else min(k, found)
        if name not in _IN_HEAD and "head" in self.places:
            found = k if (k := self.nearest(("head",))) >= 0 else found
        return found


def tags_of(page: str) -> Iterator[tuple[str, str | None, bool, str]]:
    """(text before, name or None at the end, is an end tag, attributes) of each tag, in time linear in the page.

    Comments and declarations are left out; as in HTML, a comment without an end reaches to the end of the page. A quote that never ends means nothing, nor do any quotes behind it; what
    looks like a tag but has no > behind it is text.
    """
    at = start = 0
    last, quotes, no_end = page.rfind(">"), True, set()
    parts: list[str] = []
    while (i := page.find("<", at)) >= 0:
        if page.startswith(("<!", "<?"), i):
            parts.append(page[start:i])
            if page.startswith("<!--", i):
                ended = _NO_COMMENT.match(page, i) or _COMMENT_END.search(page, i + 4)
                end = ended.end() if ended else 0
            else:
                end = page.find(">", i) + 1
            at = start = end or len(page)
            continue
        m = _OPEN.match(page, i) if i < last else None
        if m is None:
            at = i + 1
            continue
        rest = _QUOTED.match(page, m.end()) if quotes else None
        quotes = rest is not None
        end = rest.end() if rest else page.find(">", m.end()) + 1
        parts.append(page[start:i])
        name, attributes = m[2].lower(), page[m.end() : end - 1]
        yield "".join(parts), name, m[1] == "/", attributes
        parts, at = [], end
        if name in _RAW and not m[1] and not attributes.rstrip().endswith("/") and name not in no_end:
            found = re.compile(rf"</{name}\s*+>", re.I).search(page, at)
            if found is None:
                no_end.add(name)
            at = found.end() if found else len(page) if name in _TO_THE_END else at
        start = at
    yield "".join(parts) + page[start:], None, False, ""


def lines_of(page: str) -> list[tuple[str, bool, bool, bool, _Group | None]]:
    """(text, lies in an article or main element, is kept out, is links alone, marked element) of each block, in page order.

    Texts are trimmed and not empty. A heading is never links alone.
    """
    out: list[tuple[str, bool, bool, bool, _Group | None]] = []
    groups: list[tuple[int, _Group, str]] = []  # open marked elements, their places in the stack and their names
    followed: Counter[str] = Counter()  # names of open marked elements
    parts: list[str] = []
    stack, dropped = _Open(), -1  # dropped: place in the stack of the element that is kept out
    link, heading, plain = False, False, False

    def add(text: str) -> None:
        nonlocal plain
        parts.append(text)
        plain = plain or not link and _WORD.search(text) is not None

    def close() -> None:
        nonlocal link, plain
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            group = groups[-1][1] if groups else None
            out.append((text, stack.nearest(_MAIN) >= 0, dropped >= 0, not plain and not heading, group))
            if group is not None and dropped < 0:
                for g in group.enclosing():
                    g.size += len(text)
        link, plain = False, False

    def end_dropped() -> None:
        nonlocal dropped
        if len(stack) <= dropped:
            close()
            dropped = -1

    def end_groups() -> None:
        if groups and len(stack) <= groups[-1][0]:
            close()
            while groups and len(stack) <= groups[-1][0]:
                followed[groups.pop()[2]] -= 1

    for text, name, ends, attributes in tags_of(page):
        add(text)
        closed = attributes.rstrip().endswith("/")
        if name is None:
            break
        if name in _RAW:  # its content is not in the texts
            continue
        if name in _BLOCKS or name in _DROPPED:
            close()
            heading = name in _HEADINGS and not ends
        elif name == "a":
            link = not ends
        elif name in _CELLS:
            parts.append(" ")
        if ends:
            if (k := stack.ended_by(name, dropped)) >= 0:
                stack.cut(k)
                end_groups()
        elif name not in _VOID and not closed:
            if (k := stack.implied_by(name)) >= 0:
                stack.cut(k)
                end_groups()
            end_dropped()
            kept_out = name in _DROPPED and not (name == "header" and stack.nearest(_MAIN) >= 0)  # an article's own header holds its title
            starts = dropped < 0 and kept_out
            mark = _marked(attributes, name) if dropped < 0 and not starts and (name not in _UNMARKED or name == "article") else 0
            if groups and dropped < 0 and (name in ("h1", "main") or (name == "article" and not mark)):
                for g in groups[-1][1].enclosing():
                    g.owns_title = True
            if starts:
                close()
                dropped = len(stack)
            if mark and name not in _UNMARKED:
                close()
                groups.append((len(stack), _Group(mark > 1, groups[-1][1] if groups else None), name))
                followed[name] += 1
                starts = True
            if name not in _FORMATTING or starts or followed[name] or (dropped >= 0 and name == stack[dropped]):
                stack.push(name)
        end_dropped()
    close()
    return out


def _regions(weights: list[int], window: int, threshold: int) -> list[tuple[int, int]]:
    """(start, end) of the runs of lines between two dives that hold a surge. A dive is a window or more of lines without weight."""
    out, start, idle, surged = [], 0, 0, False
    n = len(weights)
    for i in range(n + 1):
        if i < n and not weights[i]:
            idle += 1
            continue
        if i == n or idle >= window:  # before the next line with weight, or the page's end
            if surged:
                out.append((start, i - idle if idle >= window else i))
            start, surged = i, False
        idle = 0
        surged = surged or sum(weights[i : i + window]) > threshold
    return out


def _aside(lines: list[tuple[str, bool, bool, bool, _Group | None]], window: int, threshold: int) -> set[int]:
    """The marked elements (by identity) whose lines go.

    None that holds the title, the main element or an article without marks goes, nor one that is only marked in passing
    (with-sidebar) and holds most of the text. The others go if the lines without marks surge or lie in an article or
    main element, or if the whole page has no surge; else the page has its text under names that say nothing, and they
    stay, the largest first, until there is a surge.
    """
    total = sum(len(line[0]) for line in lines)
    groups = {id(g): g for line in lines if line[4] is not None for g in line[4].enclosing()}
    gone = {i for i, g in groups.items() if not (g.owns_title or (not g.strong and 2 * g.size > total))}
    surges = lambda rest: _regions([0 if line[3] and not line[1] else len(line[0]) for line in rest], window, threshold)
    order = sorted(gone, key=lambda i: -groups[i].size) if surges(lines) else []
    while order:
        rest = [line for line in lines if line[4] is None or not any(id(g) in gone for g in line[4].enclosing())]
        if any(line[1] for line in rest) or surges(rest):
            break
        # the next largest comes back, with all of its size
        size = groups[order[0]].size
        while order and groups[order[0]].size == size:
            gone.discard(order.pop(0))
    return gone


def main_text(page: str, window: int = WINDOW, threshold: int = THRESHOLD) -> str:
    found = [line for line in lines_of(page) if not line[2]]
    aside = _aside(found, window, threshold) if any(line[4] for line in found) else set()
    lines = [(text, inside, links) for text, inside, _, links, group in found if group is None or not any(id(g) in aside for g in group.enclosing())]
    if not lines:
        return ""
    # inside an article or main element a line counts twice, and links count too
    weights = [len(text) * BONUS if inside else 0 if links else len(text) for text, inside, links in lines]
    regions = _regions(weights, window, threshold)
    if not regions:
        # no surge: a short page, all that is not kept out
        return "\n".join(text for text, _, _ in lines)
    sizes = [sum(weights[a:b]) for a, b in regions]
    named = [any(inside for _, inside, _ in lines[a:b]) for a, b in regions]
    if 2 * sum(w for w, own in zip(sizes, named) if own) > sum(sizes):
        regions = [r for r, own in zip(regions, named) if own]
    return "\n".join(text for text, _, _ in lines[regions[0][0] : regions[-1][1]])


def extract(pages: DataFrame, window: int = WINDOW, threshold: int = THRESHOLD) -> DataFrame:
    """page_id, url, text, n_chars of each page; a null or empty page has an empty text. Repeated rows stay repeated, other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", window, threshold) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
