"""Web pages as lines: elements, what never belongs to an article, and the part that holds the prose.

A page becomes lines, one for each block element, in page order, with the characters of it that are
links, its article element and the element that holds it. Menus, forms, adverts and the like, by
element, role or class, are left out. ``densest`` chooses among the elements by how much
prose they hold.

Defined cases: tags left open end with their parent; a page cut off inside a comment loses that
rest; stray quotes in tags end with the tag; elements may lie in each other to any depth; references without
a semicolon are read as browsers do, or stay as they are written.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from html.entities import html5

#: Characters outside of a list (of comments, of stories) with which it isn't what a page is about.
LIST_REST = 80
#: What an element's text counts for in the element around it.
SHARE = 0.8

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption search".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SPACED = frozenset("br td th img".split())
#: Elements that hold paragraphs; the lines of one stay together.
HOLDERS = frozenset("article blockquote center details div main section td".split())
#: Elements whose text never belongs to an article.
OUTSIDE = frozenset(
    "aside audio button canvas datalist dialog fieldset footer form head header iframe input label legend math menu meter nav noembed noframes noscript "
    "object optgroup option output progress script search select style svg template textarea title video xmp".split()
)
#: Words in class and id attributes that say the same, alone or in a compound with each other or the words of BESIDE.
OUTSIDE_WORDS = frozenset(
    "ad ads adbox advert advertisement advertisements adverts adslot adsense banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright "
    "disclaimer discussion disqus dropdown feedback footer form gdpr header hidden legal login masthead menu modal nav navbar navigation navi newsletter notice notices notification "
    "pager pagination popup popover promo promoted promotion recommended recommendations related replies reply respond responses rss search share sharing sidebar sidenav "
    "signin signup skip social sponsor sponsored subscribe subscription tags toc toolbar topbar topnav tracking widget widgets warning alert".split()
)
BESIDE = frozenset(
    "site page main top bottom left right primary secondary global mobile user post article entry box block list section area wrapper wrap container bar inner content "
    "item items unit panel link links text message title form and thread threads layer layers overlay root holder user users v list lists view version count body".split()
)
#: Of these words those that mark an element in a compound with any other words but those of UNLIKE.
SURE_WORDS = frozenset("advert adverts advertisement advertisements adsense breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus gdpr masthead newsletter sidebar sidenav".split())
UNLIKE = frozenset("with without no not has have is hide show enable enabled disable disabled before after on off open closed".split())
#: Of these words those that a paragraph of an article may have.
MILD_WORDS = frozenset("alert copyright disclaimer legal notice notices notification share sharing social tags warning".split())
#: Those of which the elements hold articles of their own.
LIST_WORDS = frozenset(
    "comment comments commentlist discussion disqus promo promoted promotion recommended recommendations related replies reply respond responses sidebar sidenav sponsored widget widgets".split()
)
TEXT_ELEMENTS = frozenset("b blockquote cite code dd dt em h1 h2 h3 h4 h5 h6 i li p pre q span strong td u".split())
OUTSIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search status toolbar".split())
IMPLIED_END = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Items of lists.
ITEMS = ("li", "dd", "dt")
#: Block elements that end an open paragraph.
ENDS_P = BLOCKS - {"body", "html", "caption", "tbody", "tfoot", "thead", "tr", "option", "optgroup", "legend"}
ENDS_AT = frozenset("article aside blockquote body div dl footer form header html main nav ol section table td th ul".split())

#: A quote opens a value right after = only; elsewhere it is part of a name or a value. One that nothing closes opens none.
_VALUE = r"(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+))?+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s>/]*)((?:[\s/]++|[^\s/>][^\s/>=]*+{_VALUE})*+)(?:>|\Z)", re.S)
_raw_end = lru_cache(len(RAW))(lambda tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I))
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|(?![\"'])([^\s>]*+)))?+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_TERMINATED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")


def unescape_terminated(text: str) -> str:
    """Character references that end in a semicolon are decoded, all else stays as it is written."""
    return _TERMINATED.sub(lambda m: entities.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


def _class_words(value: str) -> set[str]:
    """Of a class or id attribute the words that mark its element: whole names, or compounds of known words only."""
    out = set()
    for name in value.split():
        parts = [w.lower() for w in _PART.findall(name)]
        told = OUTSIDE_WORDS.intersection(parts)
        known = all(w in OUTSIDE_WORDS or w in BESIDE for w in parts) or (SURE_WORDS.intersection(parts) and not UNLIKE.intersection(parts))
        if told and known and not (parts[0] in ("post", "article", "entry") and "header" in told):
            out |= told
    return out


def _outside(tag: str, rest: str, in_article: bool) -> tuple[bool, str]:
    """Whether an element never belongs to an article, and what it is if it doesn't unless it holds one: "part" or "list"."""
    if tag in OUTSIDE and tag != "form":
        return True, ""
    kind = "part" if tag == "form" else ""
    if tag in ("body", "html", "article", "main") or not rest or rest.isspace():
        return False, kind
    for name, *values in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id"):
            told = _class_words(value)
            if in_article and tag in TEXT_ELEMENTS:
                told -= MILD_WORDS
            if told:
                kind = "list" if kind == "list" or told & LIST_WORDS else "part"
        elif name == "role":
            if value.lower() in OUTSIDE_ROLES:
                return True, ""
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True, ""
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, ""
    return False, kind


def _main(tag: str, rest: str) -> bool:
    return tag in ("article", "main") or (bool(rest) and re.search(r"role\s*=\s*[\"']?(?:main|article)\b|itemprop\s*=\s*[\"']?articleBody\b", rest, re.I) is not None)


#: Of a line: whether it is outside, the number of its article or 0, the innermost element around it that is outside unless it holds the article, or -1.
State = tuple[bool, int, int]


class _Lines:
    """Lines of a page: text, characters of it in links, state, the number of the element that holds it or 0."""

    def __init__(self, unescape: Callable[[str], str]) -> None:
        self.unescape = unescape
        self.rows: list[tuple[str, int, State, int]] = []
        self.listed: list[bool] = []  # of each row, whether it is in an item of a list
        self.text: list[str] = []
        self.in_item = False
        self.linked = self.holder = 0
        self.state: State = (False, 0, -1)

    def add(self, text: str, link: bool, state: State, holder: int, item: bool = False) -> None:
        if state != self.state:
            if text.isspace():
                return
            self.end()
            self.state = state
        if not self.text:
            self.holder, self.in_item = holder, item
        self.text.append(text)
        self.linked += len(text) if link else 0

    def end(self) -> None:
        if self.text:
            text = " ".join(self.unescape("".join(self.text)).split())
            if text:
                self.rows.append((text, self.linked, self.state, self.holder))
                self.listed.append(self.in_item)
        self.text, self.linked = [], 0


class _Stack:
    """Open elements: tag, state, in a link, holder.

    Each scope, which an element of ENDS_AT opens, counts the open tags in it, so
    that looking for one that isn't there takes no walk.
    """

    def __init__(self) -> None:
        self.rows: list[tuple[str, State, bool, int]] = []
        self.all: Counter[str] = Counter()
        self.scopes: list[tuple[int, Counter[str]]] = [(0, Counter())]  # place of its element, tags above it

    def top(self) -> tuple[State, bool, int]:
        return self.rows[-1][1:] if self.rows else ((False, 0, -1), False, 0)

    def push(self, tag: str, state: State, link: bool, holder: int) -> None:
        if tag in ENDS_AT:
            self.scopes.append((len(self.rows), Counter()))
        else:
            self.scopes[-1][1][tag] += 1
        self.all[tag] += 1
        self.rows.append((tag, state, link, holder))

    def close(self, tags: set[str] | frozenset[str], beyond: bool = False) -> None:
        """End the last open element of ``tags`` and what is in it; one outside of the scope only if ``beyond``."""
        at, inside = self.scopes[-1]
        around = len(self.scopes) > 1 and self.rows[at][0] in tags
        if not around and not any(inside[t] for t in tags) and not (beyond and any(self.all[t] for t in tags)):
            return
        while True:
            tag = self.rows.pop()[0]
            self.all[tag] -= 1
            if tag in ENDS_AT:
                self.scopes.pop()
            else:
                self.scopes[-1][1][tag] -= 1
            if tag in tags:
                return


@dataclass
class Page:
    """title; of the lines that aren't outside: text, characters of it in links, the number of its article or 0, of its holder or 0; whether each is in an item of a list; of each holder the one around it."""

    title: str
    lines: list[tuple[str, int, int, int]]
    listed: list[bool]
    parents: list[int]


def parse(page: str, unescape: Callable[[str], str] = entities.unescape) -> Page:
    out, stack = _Lines(unescape), _Stack()
    at, articles, parents, title = 0, 0, [0], None
    doubtful: list[tuple[str, bool, int]] = []  # of elements that a word marks: kind, whether in an article, the next one around
    state, link, holder = stack.top()
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            out.add(page[at:], link, state, holder)
            break
        if m.start() > at:
            out.add(page[at : m.start()], link, state, holder, any(stack.all[t] for t in ITEMS))
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            out.end()
        elif tag in SPACED:
            out.add(" ", False, state, holder)
        if m[1]:
            stack.close({tag}, beyond=tag in ENDS_AT)
        else:
            if ends := IMPLIED_END.get(tag, set()) | ({"p"} if tag in ENDS_P else set()):
                stack.close(ends)
            if tag in RAW:
                end = _raw_end(tag).search(page, at)
                if tag == "title" and title is None:
                    title = page[at : end.start() if end else len(page)]
                at = end.end() if end else len(page)
            elif tag not in VOID and not m[3].endswith("/"):
                (outside, article, around), linked, inner = stack.top()
                surely, kind = _outside(tag, m[3], article > 0)
                if kind:
                    doubtful.append((kind, article > 0, around))
                    around = len(doubtful) - 1
                if not article and _main(tag, m[3]):
                    article = articles = articles + 1
                if tag in HOLDERS:
                    parents.append(inner)
                    inner = len(parents) - 1
                stack.push(tag, (outside or surely, article, around), linked or tag == "a", inner)
        state, link, holder = stack.top()
    out.end()
    inside = _inside(out.rows, doubtful)
    kept = [(text, linked, article, holder, item) for (text, linked, (outside, article, around), holder), item in zip(out.rows, out.listed, strict=True) if not outside and (around < 0 or inside[around])]
    return Page(" ".join(unescape(title or "").split()), [x[:4] for x in kept], [x[4] for x in kept], parents)


def _upward(values: list[int], doubtful: list[tuple[str, bool, int]]) -> list[int]:
    """Sums over each element and all within it."""
    out = list(values)
    for e in range(len(doubtful) - 1, -1, -1):
        if doubtful[e][2] >= 0:
            out[doubtful[e][2]] += out[e]
    return out


def _inside(rows: list[tuple[str, int, State, int]], doubtful: list[tuple[str, bool, int]]) -> list[bool]:
    """Of each element that a word marks, whether it and all around it hold an article or, on a page without one, most of its text.

    Lists (of comments, of other stories) do so only if no article, or no text, is elsewhere.
    """
    size = [0 if outside else max(len(text) - linked, 0) for text, linked, (outside, _, _), _ in rows]
    seen = any(n and article and around < 0 for n, (_, _, (_, article, around), _) in zip(size, rows, strict=True))
    share, articles = [0] * len(doubtful), [0] * len(doubtful)
    for n, (_, _, (_, article, around), _) in zip(size, rows, strict=True):
        if around >= 0:
            share[around] += n
            articles[around] += n > 0 and article > 0
    share, articles = _upward(share, doubtful), _upward(articles, doubtful)
    holds = {e for e, (kind, within, _) in enumerate(doubtful) if articles[e] and not within and (kind == "part" or not seen)}
    if not (seen or holds):
        left = sum(n for n, (_, _, (_, _, around), _) in zip(size, rows, strict=True) if around < 0)
        holds = {e for e, (kind, _, _) in enumerate(doubtful) if 2 * share[e] > sum(size) and (kind == "part" or left < LIST_REST)}
    out: list[bool] = []
    for e, (_, _, around) in enumerate(doubtful):
        out.append(e in holds and (around < 0 or out[around]))
    return out


def densest(page: Page) -> list[str]:
    """The lines of the part of the page that holds most of its prose.

    An element's weight is the text outside of links of its own lines, and a share of what the elements in it
    have, so that neither a single paragraph nor the whole body wins where the article is in between. Of the
    heaviest element's lines, mostly-linked runs at its ends are left out.
    """
    weight = [0.0] * len(page.parents)
    for text, linked, _, holder in page.lines:
        if 2 * linked <= len(text):
            weight[holder] += len(text) - linked
    own = list(weight)
    for h in range(len(weight) - 1, 0, -1):
        own[page.parents[h]] += SHARE * own[h]
    best = max(range(len(own)), key=lambda h: (own[h], h))
    within = [h == best for h in range(len(own))]
    for h in range(best + 1, len(own)):
        within[h] = within[page.parents[h]]
    rows = [(text, linked) for text, linked, _, holder in page.lines if within[holder]]
    prose = [i for i, (text, linked) in enumerate(rows) if 2 * linked <= len(text)]
    return [text for text, _ in rows[prose[0] : prose[-1] + 1]] if prose else []
