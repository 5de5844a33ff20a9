"""Main text of web pages by line-block distribution.

Markup is stripped to lines (one per block element), tags by HTML's rules for attributes and quotes.  Lines within a menu,
header, footer, sidebar, advert, notice, form or comment list are boilerplate and leave the page first.  A remaining line weighs
its characters that are not in links; within an ``<article>`` or ``<main>`` it weighs all of them, and if these roots hold
at least half of a page's weight, lines outside weigh nothing.  The sums over sliding windows of ``WINDOW`` lines then
show the text on every page: it surges where a window holds ``SURGE`` characters (or half of the page's best window, if that
is less), and dives where a whole window is empty.  The lines between are kept in page order, and with a line of
a root all of that root, however short; a root without a surge, such as a teaser beside a long story, is not.

An element with a noise word in its class or id that wraps the page's content is no boilerplate.  Time is linear in the page.

Defined cases: null or empty pages have no text; a page cut off within a tag, element or character reference is read
as far as it goes; repeated rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left, bisect_right
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

WINDOW = 3
SURGE = 60

# Elements dropped with all they hold.
RAW = "script style noscript template svg math iframe object canvas audio video title textarea select".split()
BOILERPLATE = frozenset("nav footer aside form menu dialog button fieldset".split())
ROOTS = frozenset(["article", "main"])
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|side-?bar|aside|ads?|advert\w*|banner|"
    r"sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|signup|share|social|"
    r"related|recommend\w*|widget|comments?|disqus|replies|reply|login|search)(?:$|[\s_-])",
    re.I,
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())

# A quote opens a value only right after "="; elsewhere it is part of a name or of an unquoted value.
_VALUE = r"(?>\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)"
_ATTRIBUTES = rf"(?>(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE}?+)?+)*+)"
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<({'|'.join(RAW)})(?=[\s/>]|\Z){_ATTRIBUTES}(?:>.*?(?:</\1(?=[\s/>]|\Z)[^>]*(?:>|\Z)|\Z)|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>\"'][^\s>]*+))?+)?+")


# Class or id words that make even an article boilerplate: one reader comment, one teaser of another article.
_ROOT_NOISE = frozenset("comment reply related promo teaser ad advert sponsored".split())
_STATES = ("has-", "with-", "no-", "is-")  # class words that describe what else the page has
_CONTENT = re.compile(r"<(?:article|main|h1)\b", re.I)


def _is_noise(name: str, attributes: str, in_root: bool) -> bool:
    if name in BOILERPLATE or name == "header" and not in_root:
        return True
    if "=" in attributes and name not in ("body", "html", "head", "main"):
        for key, *values in _ATTRIBUTE.findall(attributes):
            key = key.lower()
            if key not in ("class", "id", "role"):
                continue
            words = "".join(values).lower().split()
            if key == "role":
                noisy = not NOISE_ROLES.isdisjoint(words)
            elif name in ROOTS:
                noisy = not _ROOT_NOISE.isdisjoint(words)
            else:
                noisy = any(NOISE.search(w) for w in words if not w.startswith(_STATES))
            if noisy:
                return True
    return False


class _Outline:
    """Where the elements of a page that have a noise word close, and where its content starts."""

    def __init__(self, page: str):
        self.end = len(page)
        self.close: dict[int, int] = {}
        lowered = page.lower()
        self.last_close = {name: lowered.rfind(f"</{name}") for name in BOILERPLATE}
        self.form_closes = [m.start() for m in re.finditer("</form", lowered)]
        self.contents = [m.start() for m in _CONTENT.finditer(page)]
        self.starts: dict[str, list[int]] = {"main": [], "article": [], "h1": [], "p": []}
        opened: dict[str, list[int]] = {}
        for m in _MARKUP.finditer(page):
            name = (m[3] or "").lower()
            if not name or name in VOID:
                continue
            if m[2]:
                if opened.get(name):
                    self.close[opened[name].pop()] = m.start()
                continue
            opened.setdefault(name, []).append(m.start())
            if name in self.starts and not (name in ROOTS and _is_noise(name, m[4], False)):
                self.starts[name].append(m.start())

    def form_holds_content(self, at: int) -> bool:
        """Whether an article, main or first-level heading lies between a form's start and its end."""
        k = bisect_left(self.form_closes, at)
        end = self.form_closes[k] if k < len(self.form_closes) else self.end
        return bisect_left(self.contents, at) < bisect_left(self.contents, end)

    def closes_after(self, name: str, at: int, page: str) -> bool:
        if name not in self.last_close:
            self.last_close[name] = page.lower().rfind(f"</{name}")
        return self.last_close[name] >= at

    def holds_content(self, name: str, start: int, in_root: bool) -> bool:
        """Whether an element with a noise word is a wrapper of the content: of the page's first main, or else first article,
        or else first heading with a paragraph.  A menu, footer or the like has to hold all of them, and no heading counts."""
        end = self.close.get(start, self.end)
        inside = lambda at: start < at < end
        known = name in BOILERPLATE or name == "header"
        if not in_root and (roots := self.starts["main"] or self.starts["article"]):
            return inside(roots[0]) and (not known or inside(roots[-1]))
        k = bisect_right(self.starts["p"], start)
        return not known and any(map(inside, self.starts["h1"][:1])) and any(map(inside, self.starts["p"][k : k + 1]))


def lines_of(page: str) -> list[tuple[str, int, bool, int]]:
    """``(text, counted characters, boilerplate, root)`` for each line of the page; ``root`` numbers the outermost article or
    main that a line is in, from 1."""
    lines: list[tuple[str, int, bool, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # element, noise, root
    opened: Counter[str] = Counter()  # how often an element is on the stack
    blocks: list[int] = []  # places of the elements on the stack that are not inline
    noisy_at: list[int] = []  # and of those with noise
    noisy_names: Counter[str] = Counter()
    parts: list[str] = []
    linked = roots = links = root_number = 0
    outline: _Outline | None = None

    def end_line() -> None:
        nonlocal linked
        text = " ".join(html_lib.unescape("".join(parts)).split())
        if text:
            size = len(text) - (0 if roots else min(linked, len(text)))
            lines.append((text, size, bool(noisy_at), root_number if roots else 0))
        parts.clear()
        linked = 0

    def push(name: str, noisy: bool, root: bool) -> None:
        nonlocal roots, links, root_number
        if name not in INLINE:
            blocks.append(len(stack))
        if noisy:
            noisy_at.append(len(stack))
            noisy_names[name] += 1
        root_number += root and not roots
        roots += root
        links += name == "a"
        opened[name] += 1
        stack.append((name, noisy, root))

    def pop(depth: int) -> None:
        nonlocal roots, links
        while len(stack) > depth:
            name, noisy, root = stack.pop()
            opened[name] -= 1
            roots -= root
            links -= name == "a"
            if noisy:
                noisy_at.pop()
                noisy_names[name] -= 1
            if name not in INLINE:
                blocks.pop()

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if links:
            linked += len(text)

    at = 0
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            if m[1]:
                add(" ")
            continue
        if name == "br":
            add(" ")
        if name in VOID:
            if name == "hr":
                end_line()
            continue
        if name not in INLINE:
            end_line()
        if m[2]:
            if opened[name]:  # what is open within goes too
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                pop(k)
            continue
        if name not in INLINE and blocks and stack[blocks[-1]][0] == "p":  # a block ends an open paragraph and what is open in it
            pop(blocks[-1])
        noisy, root = _is_noise(name, m[4], roots > 0), name in ROOTS
        if noisy or root and noisy_at:
            outline = outline or _Outline(page)
        if noisy and name == "form":  # a form around the whole page is no boilerplate
            noisy = not outline.form_holds_content(at)
        elif noisy and name not in ROOTS:  # nor is a wrapper of the content
            noisy = not outline.holds_content(name, m.start(), roots > 0)
        if root and not noisy and noisy_at:  # an unclosed menu does not swallow the article
            while noisy_at and not any(n and outline.closes_after(x, at, page) for x, n in noisy_names.items()):
                pop(noisy_at[-1])
        if not (name == "a" and "href" not in m[4].lower()):
            push(name, noisy, root and not noisy)
    rest = page[at:]
    add(rest[:-1] if rest.endswith("<") else rest)
    end_line()
    return lines


def window_sums(weight: list[int], window: int) -> list[int]:
    """Sums over the windows that end at each line, and at the places after the last."""
    return [sum(weight[max(0, k - window + 1) : k + 1]) for k in range(len(weight) + window - 1)]


def regions(weight: list[int], need: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Runs of lines from where window sums leave zero to where they are zero again, if one between reaches ``need``."""
    out, start, surged = [], None, False
    for k, total in enumerate([*window_sums(weight, window), 0]):
        if total and start is None:
            start, surged = k, False
        if start is not None:
            surged = surged or total >= need
            if not total:
                if surged:
                    out.append((start, min(k, len(weight))))
                start = None
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The text between the surge and dive points of the page's line-block distribution."""
    lines = [x for x in lines_of(page) if not x[2]] if page else []
    inside = sum(size for _, size, _, root in lines if root)
    by_root = inside > 0 and inside >= sum(size for _, size, _, root in lines if not root)
    weight = [size if root or not by_root else 0 for _, size, _, root in lines]
    need = min(surge, max(window_sums(weight, window), default=0) / 2)
    if inside:  # a root that does not surge by itself is a teaser beside the text
        in_root: dict[int, list[int]] = {}
        for _, size, _, root in lines:
            in_root.setdefault(root, []).append(size)
        teasers = {r for r, own in in_root.items() if r and max(window_sums(own, window)) < need}
        weight = [w for w, x in zip(weight, lines) if x[3] not in teasers]
        lines = [x for x in lines if x[3] not in teasers]
    found = {k for a, b in regions(weight, need, window) for k in range(a, b)}
    if by_root:
        kept = {lines[k][3] for k in found} - {0}
        return " ".join(text for text, _, _, root in lines if root in kept)
    return " ".join(text for k, (text, *_) in enumerate(lines) if k in found)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page row: page_id, url, text, n_chars (code points of the text)."""

    def extract(ids, urls, pages):
        texts = [main_text(p) for p in pages]
        return {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}

    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    return map_texts(rows, "page_id long, url string, text string, n_chars long", extract, "html")
