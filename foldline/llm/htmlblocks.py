"""Flat text blocks of a web page, read in one pass whose time grows with the page's length.

Tags are found by one scanner that never looks at a character twice in the same way: quotes count only behind an equals
sign, and if they leave a tag without an end, they count no more in that page. Which end tag closes which container is settled
by a stack for each name; what the open containers say is kept in counters.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

# Elements and attribute words with a meaning here.
#: Elements whose content is no markup, and never text of the page.
RAW = "script style textarea title iframe noframes xmp"
#: Elements whose content is left out where they are closed.
OPAQUE = "noscript template select svg object button canvas audio video map datalist"
#: Elements that don't end a block.
INLINE = (
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr nobr br"
)
CONTAINERS = "article main section div nav header footer aside form ul ol dl table td th figure blockquote details dialog menu fieldset center body"
BOILERPLATE = "nav footer aside form menu dialog fieldset"
BOILERPLATE_ROLES = "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form"
#: Elements that hold running text.
PARAGRAPHS = "p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt figcaption caption td th summary"
#: What a class or id names if its last telling word is one of these.
NOISE = (
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsors sponsored promo promotion promos cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription sidebar widget widgets related recommended recommendations share sharing "
    "social nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead login signin signup register pagination pager toolbar "
    "copyright legal disclaimer banner topbar search"
)
COMMENTS = "comment comments commentlist disqus respond replies"
#: Words of a class or id that tell layout only; the word before them counts.
LAYOUT = (
    "area bar block body box button buttons card col column container content cta form grid group holder icon icons inner item items label left "
    "link links list outer panel right row section slot space text title top bottom unit wrap wrapper zone posts articles stories site page main"
)
#: Words that turn the next one round, or make it a state.
STATES = "has no with without show hide is not open closed"

_RAW, _OPAQUE, _INLINE = set(RAW.split()), set(OPAQUE.split()), set(INLINE.split())
_CONTAINERS, _BOILERPLATE, _ROLES = set(CONTAINERS.split()), set(BOILERPLATE.split()), set(BOILERPLATE_ROLES.split())
_PARAGRAPHS, _NOISE, _COMMENTS = set(PARAGRAPHS.split()), set(NOISE.split()), set(COMMENTS.split())
_LAYOUT, _STATES = set(LAYOUT.split()), set(STATES.split())
_MATCHED = _CONTAINERS | _OPAQUE

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
#: From a tag's name to its end: a quoted value is passed over whole.
QUOTED_END = re.compile(r"(?:[^>=]++|=(?:\s*+(?:\"[^\"]*+\"|'[^']*+'))?+)*+>")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORDS = re.compile(r"[a-z]+")
#: What a cut-off tag at the page's end looks like.
CUT_OFF = re.compile(r"[a-zA-Z/!?]")


@dataclass(slots=True)
class Tag:
    begin: int
    end: int
    name: str  # lower case; empty for what is only passed over
    close: bool
    attrs: str


@dataclass(slots=True)
class Block:
    text: str
    words: int = 0
    linked: int = 0
    element: bool = False  # in an element of boilerplate, or a hidden one
    named: bool = False  # in a container whose class or id says boilerplate
    main: bool = False
    paragraph: bool = False

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def tags_of(page: str) -> Iterator[Tag]:
    """All tags in page order; comments, declarations and the content of raw elements are passed over as nameless ones.

    A tag without an end is text, but at the page's end, where it is passed over.
    """
    at, quoted, n = 0, True, len(page)
    while (begin := page.find("<", at)) >= 0:
        if page.startswith("<!--", begin):
            stop = page.find("-->", begin + 4)
            at = stop + 3 if stop >= 0 else n
            yield Tag(begin, at, "", False, "")
            continue
        follows = page[begin + 1 : begin + 2]
        if follows in ("!", "?"):
            stop = page.find(">", begin)
            at = stop + 1 if stop >= 0 else n
            yield Tag(begin, at, "", False, "")
            continue
        name = NAME.match(page, begin + 1)
        if name is None:
            at = begin + 1
            continue
        end = -1
        if quoted:
            found = QUOTED_END.match(page, name.end())
            quoted = found is not None  # else quotes count no more
            end = found.end() if found else -1
        if end < 0:
            end = page.find(">", name.end()) + 1
            if not end:
                yield Tag(begin, n, "", False, "")
                return
        close = name[0][0] == "/"
        called = name[0].lstrip("/").lower()
        attrs = page[name.end() : end - 1]
        at = end
        if called in _RAW and not close and not attrs.endswith("/"):
            stop = re.compile(rf"</{called}(?=[\s/>])", re.I).search(page, end)
            at = (page.find(">", stop.end()) + 1 if stop else 0) or n
            yield Tag(begin, at, "", False, "")
            continue
        yield Tag(begin, end, called, close, attrs)


def _says(value: str) -> tuple[bool, bool]:
    """(boilerplate, comments) that a class or id attribute names.

    A name is judged by its last word that isn't about layout, as in "cookie-notice" or "footer-inner": "social-history" is about
    history, and "has-sidebar" about nothing here.
    """
    noise = comments = False
    for token in value.split():
        words = WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower())
        if not words or words[0] in _STATES:
            continue
        while len(words) > 1 and words[-1] in _LAYOUT:
            words.pop()
        comments |= words[-1] in _COMMENTS
        noise |= words[-1] in _NOISE
    return noise, comments


def _meaning(name: str, attrs: str, inside_main: bool) -> tuple[bool, bool, bool]:
    """(boilerplate by element, boilerplate by name, main) that a container's tag claims."""
    element, main = name in _BOILERPLATE or (name == "header" and not inside_main), name in ("article", "main")
    named = False
    if attrs and not attrs.isspace():
        for m in ATTRIBUTE.finditer(attrs):
            key = m[1].lower()
            raw = (m[2] or "").strip("\"'")
            value = raw.lower()
            if key in ("class", "id"):
                noise, comments = _says(raw)
                # Of a whole page or article such names tell its layout, but an article may be a reader's comment.
                named |= (noise and name not in ("body", "main", "article")) or (comments and name not in ("body", "main"))
            elif key == "role":
                element |= value in _ROLES
                main |= value in ("main", "article")
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                element = True
    return element, named, main and not element and not named


class _Containers:
    """The open containers and counts of what they say.

    One that is never closed says nothing once another container has begun.
    """

    def __init__(self) -> None:
        self.stack: list[tuple[int, tuple[bool, bool, bool]]] = []  # number of the tag, what it says
        self.place: dict[int, int] = {}
        self.count = [0, 0, 0]
        self.loose: list[int] = []  # unclosed ones that still count

    def _uncount(self, says: tuple[bool, bool, bool]) -> None:
        for k in range(3):
            self.count[k] -= says[k]

    def settle(self) -> None:
        for k in self.loose:
            if k in self.place:
                i = self.place[k]
                self._uncount(self.stack[i][1])
                self.stack[i] = (k, (False, False, False))
        self.loose = []

    def open(self, k: int, says: tuple[bool, bool, bool], closed: bool) -> None:
        self.place[k] = len(self.stack)
        self.stack.append((k, says))
        for i in range(3):
            self.count[i] += says[i]
        if not closed:
            self.loose.append(k)

    def close(self, k: int) -> None:
        """Close the container of tag k with all that is open inside it."""
        while k in self.place:
            top, says = self.stack.pop()
            del self.place[top]
            self._uncount(says)


def blocks_of(page: str) -> list[Block]:
    """The flat blocks of a page that have text, in page order."""
    tags = list(tags_of(page))
    # An end tag closes the last open one of its name.
    ends: dict[int, int] = {}
    begins: dict[int, int] = {}
    open_at: dict[str, list[int]] = {}
    for k, t in enumerate(tags):
        if t.name not in _MATCHED:
            continue
        if not t.close:
            open_at.setdefault(t.name, []).append(k)
        elif open_at.get(t.name):
            begins[k] = open_at[t.name].pop()
            ends[begins[k]] = k
    out: list[Block] = []
    held = _Containers()
    parts: list[str] = []
    linked = 0
    in_link = paragraph = False

    def say(text: str) -> None:
        nonlocal linked
        text = html.unescape(text)
        parts.append(text)
        if in_link:
            linked += len(text.split())

    def flush() -> None:
        nonlocal linked
        words = "".join(parts).split()
        if words:
            element, named, main = (c > 0 for c in held.count)
            out.append(Block(" ".join(words), len(words), min(linked, len(words)), element, named, main, paragraph))
        parts.clear()
        linked = 0

    at = 0
    skip_to = -1  # the tag that ends what is left out
    for k, t in enumerate(tags):
        if k < skip_to:
            continue
        if t.begin > at and k != skip_to:
            say(page[at : t.begin])
        at = t.end
        if not t.name:
            if page.startswith("<!", t.begin) or page.startswith("<?", t.begin):
                continue
            parts.append(" ")
            continue
        if t.name in _OPAQUE:
            parts.append(" ")
            if not t.close and k in ends:
                skip_to = ends[k]
            continue
        if t.name in _INLINE:
            if t.name == "a":
                in_link = not t.close and "href" in t.attrs.lower()
            elif t.name in ("br", "img", "input"):
                parts.append(" ")
            continue
        flush()
        paragraph = not t.close and t.name in _PARAGRAPHS
        if t.name not in _CONTAINERS:
            continue
        held.settle()
        if t.close:
            if k in begins:
                held.close(begins[k])
        else:
            whole = t.name in ("body", "article", "main")
            held.open(k, _meaning(t.name, t.attrs, held.count[2] > 0), closed=k in ends or whole)
            in_link = False
    if at < len(page):
        say(page[at:])
    flush()
    return out
