"""Main text of HTML pages by tag-path ratios.

A page is cut into blocks, the runs of text between block-level tags, each with
its path of tags from the root. Per path, the length of its text and its
punctuation are set against the number of its blocks, and its share of link
text against all of it; the two ratios are fused and smoothed over
neighbouring blocks of the page. A path whose blocks reach a part of the
page's highest value is content, with all its blocks, so short paragraphs go
with long ones. So is every other path (of no large share of link text) inside
the content's element, so tables and lists of short items stay whatever the
length of the paragraphs around them: the page's ``article`` and ``main``
elements, or without these the innermost container of most of the text found
so. What lies around a page's ``article`` or ``main`` element counts for less
than what is in it.

Elements that say what they are by tag, role or attribute (navigation, footers,
dialogs, what is hidden and the like; inline elements by attribute) are left out
before. A class or id that names reader comments, adverts, notices or sharing
leaves its element out whatever its length, unless it encloses the page's first
heading of the first rank or its first ``article`` or ``main`` element, or no
text would remain. A form, or another name (sidebar, widget, ...), is a hint
only: elements of such a path are left out if they hold no more than half of the
page's unlinked text, so a wrapper around the main text stays, and none if no
text would remain. Inside the content's element nothing else is left out: lists
of links, linked paragraphs and paragraphs of any name stay.

Defined results: null, empty or text-free pages have an empty text; markup that
is broken is read leniently (unclosed elements end with their parent, scripts
and the like included, stray end tags are ignored, an unclosed comment runs to
the end); repeated rows are read one by one; other columns stay, columns with the result's names are replaced.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: a path is content from this part of the page's highest value on
PART = 0.15
#: and with no larger share of link text
MAX_LINKS = 0.6
#: elements with a hint are left out up to this part of the page's text
MINOR = 0.5
#: an element with more than this part of the content's text is the content's
MOST = 0.8
#: what lies outside the page's article or main element counts so much
OUTSIDE = 0.1
#: weights of a block's neighbours in smoothing
KERNEL = (0.1, 0.2, 0.4, 0.2, 0.1)

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[(.*?)(?:\]\]>|\Z)|[!?][^>]*>"
                  r"|(/?)([A-Za-z][^\s/>]*)(?:((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)|([^>]*))>)", re.S)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in
        ("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes")}
#: left out without ending the block around them; empty when self-closed, as is all within svg and math
_EMBEDDED = {"template", "svg", "math", "noscript", "select", "object", "canvas", "audio", "video"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
           "kbd", "label", "mark", "nobr", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike",
           "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img", "picture", "source"}
_LEFT_OUT = {"head", "nav", "footer", "aside", "button", "dialog", "menu", "fieldset", "datalist", "output"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog",
          "menu", "menubar", "toolbar", "tooltip", "status"}
#: what these names say is left out wherever it is
_NEVER = {"ad", "ads", "adv", "advert", "advertisement", "advertising", "adverts", "adsense", "sponsor", "sponsored",
          "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "popup", "modal",
          "overlay", "comment", "comments", "disqus", "respond", "reply", "replies", "share", "sharing", "social"}
#: these are hints
_NAMES = {"banner", "alert", "newsletter", "subscribe", "subscription", "signup", "login", "menu", "nav", "navbar", "navigation",
          "breadcrumb", "breadcrumbs", "sidebar", "aside", "widget", "widgets", "footer", "masthead", "related", "recommended",
          "pagination", "pager", "copyright", "disclaimer", "hidden", "teaser", "toolbar"}
#: with one of these a name says how the element is, not what it is
_STATES = {"with", "has", "no", "open", "closed", "enabled", "disabled", "on", "off", "count", "status"}
#: a header of one of these is the article's own
_OF_CONTENT = {"article", "content", "entry", "post", "story"}
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: an element that closes an open one of these, up to the nearest limit
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
           "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：]")
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: never the content's element, but their parents are
_PROSE = {"p", "blockquote", "pre", "figure", "figcaption", *_HEADINGS}
_TEXT = {"p", "li", "ul", "ol", "dt", "dd", "dl", "blockquote", "pre", "figure", "figcaption", *_HEADINGS}


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" \
        or "display:none" in attributes.get("style", "").replace(" ", "").lower()


def _left_out(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    if tag in _LEFT_OUT or (tag == "header" and not inside):
        return True
    if tag in ("html", "body", "main") or not attributes:
        return False
    return _hidden(attributes) or attributes.get("role", "").lower() in _ROLES


#: what an element's form or names say of it
PLAIN, HINT, NEVER = 0, 1, 2


def _doubt(tag: str, attributes: dict[str, str], inside: bool) -> int:
    if tag in ("html", "body", "main"):
        return PLAIN
    found = HINT if tag == "form" else PLAIN
    for part in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        names = {n.lower() for n in _NAME.findall(part)}
        if names & _STATES:
            continue
        if names & _NEVER:
            return NEVER
        if names & _NAMES or ("header" in names and not inside and not _OF_CONTENT & names):
            found = HINT
    return PLAIN if inside and tag in _PROSE else found


class _Paths:
    """Tag paths by number; a path is its parent's number and a step, so deep pages take linear memory."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[int, str, str], int] = {}
        self.last = [""]

    def child(self, parent: int, tag: str, name: str) -> int:
        key = (parent, tag, name)
        if key not in self.numbers:
            self.numbers[key] = len(self.last)
            self.last.append(tag)
        return self.numbers[key]


class _Block:
    __slots__ = ("parts", "links", "path", "inside", "element")

    def __init__(self, path: int, inside: bool, element: int) -> None:
        self.parts: list[str] = []
        self.links, self.path, self.inside, self.element = 0, path, inside, element


def blocks(html: str) -> tuple[list[tuple[int, str, bool, float, int]], list[tuple[int, str, int, int]], list[str]]:
    """(path, text, inside an article or main element, share of link text, element) of each block in page order,
    (parent, tag, path, doubt) of each element that is not left out, and the last tag of each path."""
    out: list[tuple[int, str, bool, float, int]] = []
    elements: list[tuple[int, str, int, int]] = [(0, "", 0, PLAIN)]
    # open elements: tag, path, left out, inside, number
    stack: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, 0)]
    opened: dict[str, int] = defaultdict(int)
    paths, block, link, at = _Paths(), _Block(0, False, 0), False, 0

    def push(tag: str, path: int, out_of: bool, inside: bool, element: int) -> None:
        stack.append((tag, path, out_of, inside, element))
        opened[tag] += 1

    def pop_from(i: int) -> None:
        for s in stack[i:]:
            opened[s[0]] -= 1
        del stack[i:]

    def close() -> None:
        nonlocal block, link
        if stack[-1][2]:
            return  # the block ends with what is left out, or goes on after it
        if block.parts:
            text = " ".join(unescape("".join(block.parts)).split())
            if text:
                out.append((block.path, text, block.inside, min(1.0, block.links / len(text)), block.element))
        _, path, _, inside, element = stack[-1]
        block, link = _Block(path, inside, element), False

    def add(raw: str) -> None:
        if raw and not stack[-1][2]:
            block.parts.append(raw)
            if link:
                block.links += len(raw)

    def end(tag: str, limits: frozenset | set = frozenset()) -> bool:
        if opened[tag]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    pop_from(i)
                    return True
                if stack[i][0] in limits:
                    return False
        return False

    for m in iter(lambda: _TAG.search(html, at), None):
        add(html[at:m.start()])
        at = m.end()
        if m[1] is not None:
            add(m[1].replace("&", "&amp;"))
        if m[3] is None:
            continue
        tag, closing = m[3].lower(), bool(m[2])
        if tag in _INLINE:
            _, path, out_of, inside, element = stack[-1]
            if closing and out_of:  # the end of an inline element that is left out, or of one in it
                i = len(stack) - 1
                while stack[i][0] in _INLINE and stack[i][0] != tag:
                    i -= 1
                if stack[i][0] == tag:
                    pop_from(i)
            elif not closing and tag not in _VOID and (out_of or (m[4] or m[5])):
                attributes = {} if out_of else _attributes(m[4] or m[5])
                if out_of or _hidden(attributes) or _doubt(tag, attributes, inside) == NEVER:
                    push(tag, path, True, inside, element)
            if tag == "br":
                add(" ")
            elif tag == "a" and not stack[-1][2]:
                link = not closing
            continue
        if closing:
            if tag not in ("html", "body") and opened[tag]:
                end(tag)
                if tag not in _EMBEDDED:
                    close()
            elif tag == "p":
                close()
            continue
        if (m[4] or m[5] or "").endswith("/") and (
                tag in _EMBEDDED or (stack[-1][2] and (opened["svg"] or opened["math"]))):
            continue
        if tag in _RAW and (done := _RAW[tag].search(html, at)):
            at = done.end()
            continue
        if tag in _EMBEDDED or tag in _RAW:
            _, path, _, inside, element = stack[-1]
            push(tag, path, True, inside, element)
            continue
        if stack[-1][0] == "p":
            pop_from(len(stack) - 1)
        if tag in _CLOSES:
            shut, limits = _CLOSES[tag]
            for t in shut:
                end(t, limits)
        if tag not in _VOID and not (tag in ("html", "body") and opened[tag]):
            _, path, out_of, inside, element = stack[-1]
            if out_of:
                push(tag, path, True, inside, element)
                continue
            attributes = _attributes(m[4] or m[5] or "")
            if _left_out(tag, attributes, inside):
                close()
                push(tag, path, True, inside, element)
                continue
            path = paths.child(path, tag, (attributes.get("class", "").split() or [""])[0])
            elements.append((element, tag, path, _doubt(tag, attributes, inside)))
            push(tag, path, False, inside or tag in ("article", "main"), len(elements) - 1)
        close()
    add(html[at:])
    del stack[1:]
    close()
    return out, elements, paths.last


def _held(elements: list[tuple[int, str, int, int]], sizes: dict[int, float]) -> list[float]:
    """The sizes within each element, from those of its own blocks."""
    held = [sizes.get(e, 0) for e in range(len(elements))]
    for e in range(len(elements) - 1, 0, -1):
        held[elements[e][0]] += held[e]
    return held


def _outside(found: list, elements: list[tuple[int, str, int, int]], out: list[bool]) -> list:
    """The blocks outside of the elements marked in ``out``; all of them if none would remain."""
    for e in range(1, len(elements)):
        out[e] = out[e] or out[elements[e][0]]
    return [f for f in found if not out[f[4]]] or found


def _without_doubtful(found: list[tuple[int, str, bool, float, int]], elements: list[tuple[int, str, int, int]]) -> list:
    """The blocks outside of elements that their names rule out, and outside of
    those with a hint whose path holds a minor part of the remaining text."""
    if not any(doubt for _, _, _, doubt in elements):
        return found
    # the page's first heading and first article or main element, and what encloses them
    kept = [False] * len(elements)
    for wanted in ({"h1"}, {"article", "main"}):
        e = next((e for e, x in enumerate(elements) if x[1] in wanted and x[3] != NEVER), 0)
        while e:
            kept[e], e = True, elements[e][0]
    never = [doubt == NEVER and not kept[e] for e, (_, _, _, doubt) in enumerate(elements)]
    found = _outside(found, elements, list(never))
    landmark = any(inside for _, _, inside, _, _ in found)
    sizes: dict[int, float] = defaultdict(float)
    for _, text, inside, share, e in found:
        sizes[e] += len(text) * (1 - share) * (1 if inside or not landmark else OUTSIDE)
    held, by_path = _held(elements, sizes), defaultdict(float)
    hint = [doubt != PLAIN and not never[e] for e, (_, _, _, doubt) in enumerate(elements)]
    for e, (_, _, path, _) in enumerate(elements):
        if hint[e]:
            by_path[path] += held[e]
    return _outside(found, elements, [hint[e] and by_path[path] <= MINOR * held[0] for e, (_, _, path, _) in enumerate(elements)])


def _container(elements: list[tuple[int, str, int, int]], sizes: dict[int, int]) -> list[bool]:
    """Which elements lie in the innermost container of most of the text, from its length by element."""
    held = _held(elements, sizes)
    # those with most of the text are nested in each other, and a parent comes before its child
    best = max(e for e in range(len(elements)) if held[e] >= MOST * held[0])
    while elements[best][1] in _TEXT:
        best = elements[best][0]
    within = [e == best for e in range(len(elements))]
    for e in range(best + 1, len(elements)):
        within[e] = within[elements[e][0]]
    return within


def main_text(html: str | None) -> str:
    """The content blocks of a page, joined by line breaks."""
    found, elements, last = blocks(html or "")
    if not found:
        return ""
    found = _without_doubtful(found, elements)
    n, length, marks, links = (defaultdict(float) for _ in range(4))
    for path, text, _, share, _ in found:
        n[path] += 1
        length[path] += len(text)
        marks[path] += len(_PUNCTUATION.findall(text))
        links[path] += share * len(text)
    landmark = any(inside for _, _, inside, _, _ in found)
    fused = {p: math.log1p(length[p] / n[p]) * (1 + math.log1p(marks[p] / n[p])) * (1 - min(1, links[p] / length[p]))
             for p in n}
    values = [fused[path] * (1 if inside or not landmark else OUTSIDE) for path, _, inside, _, _ in found]
    half, total, count = len(KERNEL) // 2, defaultdict(float), defaultdict(int)
    for i, (path, _, inside, _, _) in enumerate(found):
        near = [(KERNEL[j - i + half], values[j]) for j in range(max(0, i - half), min(len(found), i + half + 1))
                if found[j][2] == inside]
        total[path] += sum(w * v for w, v in near) / sum(w for w, _ in near)
        count[path] += 1
    score = {p: total[p] / count[p] for p in total}
    least = PART * max(score.values())
    text_like = {p for p in score if links[p] <= MAX_LINKS * length[p] or last[p] in _HEADINGS}
    content = {p for p in text_like if score[p] >= least}
    if landmark:
        return "\n".join(text for path, text, inside, _, _ in found if path in content or inside)
    if not content:
        return ""
    sizes: dict[int, int] = defaultdict(int)
    for path, text, _, _, element in found:
        if path in content:
            sizes[element] += len(text)
    within = _container(elements, sizes)
    return "\n".join(text for path, text, _, _, e in found if path in content or within[e])


def extract(df: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Replace the ``html`` column by ``text``, the main text of each page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = pa.array([main_text(h) for h in b.column(b.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], names=names)

    rest = [c for c in df.columns if c not in (html, text)]
    names = [*rest, text]
    return df.select(*rest, F.col(html).cast("string").alias("__html")).mapInArrow(
        run, df.select(*rest, F.lit("").alias(text)).schema)
