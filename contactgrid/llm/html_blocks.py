"""Blocks of text of an HTML page, with what markup says of each."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

#: Elements that end a block of text.
BLOCK_TAGS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without an end tag.
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup.
RAW_TAGS = set("script style textarea title noscript iframe noembed noframes xmp".split())
#: Elements that are never the article.
SKIP_TAGS = set("head nav footer aside form button select dialog menu template svg math object audio video canvas".split())
#: Words in class, id or role of what isn't the article.
SKIP_WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist consent "
    "contentinfo cookie cookies copyright disqus discussion footer form gdpr header hidden legal login masthead menu menus modal nav navbar navigation "
    "newsletter notice notices notification notifications outbrain pager pagination popup popover promo promos promotion related recommended replies reply "
    "search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription taboola tags toolbar topbar widget widgets".split()
)
#: Words that beside those say where or in what form such a part stands. Any other word makes a name one of the article's.
FORM_WORDS = set(
    "area bar block bottom box button buttons center col column container content floating form global group header icon icons inline inner item items js left "
    "link links list logo main media menu message module outer overlay page panel placeholder post posts primary reader right row secondary section site slot social "
    "sticky text thread top unit user view wrap wrapper".split()
)
#: Words beside which PART_WORDS name parts of the article.
ARTICLE_WORDS = {"article", "post", "entry", "story", "content", "main", "body", "text"}
PART_WORDS = {"header", "tags", "form", "menu", "social"}
SKIP_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"""[>]|=\s*(["'])""")
_NUMBER = re.compile(r"&#([xX]?)0*([0-9a-fA-F]+)")
_RAW_END = {x: re.compile(rf"</{x}\b[^>]*>?", re.I) for x in RAW_TAGS}
_NAMES = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden|aria-label)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_PLAIN = (0, 0, 0, 0)
_NAMED = SKIP_TAGS | {"article", "main", "header"}
_ROLE_MAIN = re.compile(r"""\brole\s*=\s*["']?main\b""", re.I)
_HEADING = re.compile(r"h[1-6]\Z")
#: Elements whose id, inside an article, is an anchor that links lead to, often made from their own words: it says nothing of what they are.
_ANCHORED = re.compile(r"(h[1-6]|p|dt|dd)\Z")


def _skipped(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element's name or attributes say that it isn't the article; ``inside`` tells whether it stands in one."""
    if tag in SKIP_TAGS:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, value in _NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value.lower() in SKIP_ROLES:
            return True
        if name == "class" or name == "id" and not (inside and _ANCHORED.match(tag)):
            for one in value.split():
                parts = {x.lower() for x in _PARTS.findall(one)}
                found = parts & SKIP_WORDS
                if found and all(x in FORM_WORDS or x.isdigit() or len(x) == 1 for x in parts - found) and not (found <= PART_WORDS and parts & ARTICLE_WORDS):
                    return True
    return False


def _decoded(text: str) -> str:
    """Text with its character references decoded; numbers beyond any character become one that stands for none."""
    if "&" not in text:
        return text
    plain = lambda m: f"&#{m[1]}{m[2] if len(m[2]) < 9 else '110000' if m[1] else '1114112'}"
    return html.unescape(_NUMBER.sub(plain, text))


def scan(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text before, whether an end tag, name, attributes) of each tag, then the text after the last one with an empty name.

    One pass from left to right: nothing is looked at again, so that any page takes time in proportion to its length. A
    value in quotes may hold anything; where its quote is never closed, and where a quote begins no value, it is a
    character like any other. Comments, declarations and what raw elements hold are left out. A tag cut off at the end is none.
    """
    at = begin = 0
    texts: list[str] = []
    last_quote = {q: page.rfind(q) for q in "\"'"}
    while (start := page.find("<", at)) >= 0:
        following = page[start + 1 : start + 2]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            texts.append(page[begin:start])
            at = begin = end + 3 if end >= 0 else len(page)
            continue
        if following in ("!", "?") or following == "/" and not page[start + 2 : start + 3].isalpha():
            end = page.find(">", start)
            texts.append(page[begin:start])
            at = begin = end + 1 if end >= 0 else len(page)
            continue
        tag = _TAG.match(page, start + 1)
        if not tag:
            at = start + 1
            continue
        end = tag.end()
        while (stop := _STOP.search(page, end)) and stop[1]:
            end = stop.end()
            if end <= last_quote[stop[1]]:
                end = page.find(stop[1], end) + 1
        texts.append(page[begin:start])
        if not stop:
            begin = len(page)
            break
        name, attributes = tag[2].lower(), page[tag.end() : stop.start()]
        yield "".join(texts), bool(tag[1]), name, attributes
        texts.clear()
        at = begin = stop.end()
        if name in RAW_TAGS and not tag[1]:
            close = _RAW_END[name].search(page, at)
            at = begin = close.end() if close else len(page)
    yield "".join([*texts, page[begin:]]), False, "", ""


def page_blocks(page: str | None) -> list[tuple[str, bool, bool, bool]]:
    """Blocks in page order: text, whether in an article, whether in the main element, whether in what is skipped.

    Character references are decoded, white space is one space, empty blocks are left out. Tags that aren't
    closed end with the element around them; end tags without a start are ignored, as are inline end tags across blocks.
    """
    found: list[tuple[str, bool, bool, bool]] = []
    names: list[str] = []
    kinds: list[tuple[int, int, int, int]] = []  # whether each open element starts an article, the main element, a skipped part, a header inside an article
    places: dict[str, list[int]] = {}  # of the open elements of each name
    block_places: list[int] = []
    counts = [0, 0, 0, 0]
    text: list[str] = []

    def flush() -> None:
        block = " ".join("".join(text).split())
        text.clear()
        if block:
            heading = counts[3] and any(_HEADING.match(x) for x in names[-3:])
            found.append((block, counts[0] > 0, counts[1] > 0, counts[2] > 0 or counts[3] > 0 and not heading))

    def close(upto: int) -> None:
        while len(names) > upto:
            name, kind = names.pop(), kinds.pop()
            places[name].pop()
            if name in BLOCK_TAGS:
                block_places.pop()
            if kind is not _PLAIN:
                counts[:] = [n - k for n, k in zip(counts, kind, strict=True)]

    for before, end, tag, attributes in scan(page or ""):
        if before:
            text.append(_decoded(before))
        block = tag in BLOCK_TAGS or not tag
        if block:
            if text:
                flush()
        elif tag == "br":
            text.append(" ")
            continue
        if end:
            if there := places.get(tag):
                if block or not block_places or block_places[-1] <= there[-1]:
                    close(there[-1])
            continue
        if not tag or tag in VOID_TAGS or tag in RAW_TAGS:
            continue
        if tag == "p" and names and names[-1] == "p":
            close(len(names) - 1)
        kind = _PLAIN
        if attributes or tag in _NAMED:
            is_main = tag == "main" or bool(attributes) and bool(_ROLE_MAIN.search(attributes))
            is_header = tag == "header"
            skip = _skipped(tag, attributes, bool(counts[0] or counts[1])) or is_header and not (counts[0] or counts[1])
            kind = (int(tag == "article"), int(is_main), int(skip), int(is_header and not skip))
            counts[:] = [n + k for n, k in zip(counts, kind, strict=True)]
        if block:
            block_places.append(len(names))
        places.setdefault(tag, []).append(len(names))
        names.append(tag)
        kinds.append(kind)
    return found


def candidate_blocks(page: str | None) -> list[tuple[str, bool, bool]]:
    """All blocks in page order: text, whether it may be the article's, whether markup says that it is.

    Those in an article may be, else those in the main element, else all, but for what is skipped.
    """
    blocks = page_blocks(page)
    for where in (1, 2):
        if any(b[where] and not b[3] for b in blocks):
            return [(b[0], b[where] and not b[3], b[where] and not b[3]) for b in blocks]
    return [(b[0], not b[3], False) for b in blocks]


def article_blocks(page: str | None) -> list[str]:
    """The blocks that may be the article."""
    return [b[0] for b in candidate_blocks(page) if b[1]]
