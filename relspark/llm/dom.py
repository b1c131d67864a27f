"""A tolerant reading of HTML into blocks: block elements and the runs of text directly inside them."""

from __future__ import annotations

import html
import re

_NAME = re.compile(r"(/?)([A-Za-z][A-Za-z0-9:-]*)")
_STOP = re.compile("[\"'>]")
_NAMED = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")

# fixed values: elements by kind
RAW = {"script", "style", "textarea", "title", "xmp", "iframe"}  # their content is no markup and runs to their end tag or the page's end
INERT = {"template"}  # not shown; left out if it has an end tag
CONTROL = {"button", "select", "datalist"}  # their text is a node of its own within the block; they end where a block begins or ends
OPTIONS = {"option", "optgroup"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
# an opening tag closes an open element of these names, up to the nearest of the second names
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"})}
# fixed values: kinds of block that tokens of class, id, role and itemprop hint at
HINTS = {
    "content": "content article post entry body text story main page hentry copy prose",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs pagination pager tabs toc links skip",
    "header": "header masthead banner topbar branding logo sitename tagline",
    "footer": "footer foot colophon copyright legal bottom credits",
    "side": "sidebar aside side rail widget widgets complementary secondary",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion adsense dfp commercial",
    "notice": "notice cookie cookies consent gdpr alert warning popup modal overlay banner toast disclaimer paywall message",
    "form": "form search login signup signin register subscribe newsletter subscription contact input",
    "comment": "comment comments commentlist disqus respond reply replies discussion responses reader readers feedback",
    "related": "related recommended recommendations more popular trending share sharing social follow tags tagcloud author bio meta byline",
}
KINDS = list(HINTS)
_BIT: dict[str, int] = {}
for _k, _name in enumerate(KINDS):
    for _w in HINTS[_name].split():
        _BIT[_w] = _BIT.get(_w, 0) | 1 << _k
TAGS = ["html", "body", "div", "section", "article", "main", "p", "h1", "h2", "ul", "li", "nav", "aside", "header", "footer", "form", "table", "blockquote", "pre", "figure", "dl", "#text", "other"]
_ALIKE = {"h3": "h2", "h4": "h2", "h5": "h2", "h6": "h2", "ol": "ul", "menu": "ul", "tr": "table", "td": "table", "th": "table", "tbody": "table", "thead": "table", "tfoot": "table", "caption": "table", "dt": "dl", "dd": "dl", "figcaption": "figure", "fieldset": "form", "legend": "form", "option": "form", "optgroup": "form", "button": "form", "select": "form", "datalist": "form", "search": "form", "center": "div"}
TAG_AT = {name: TAGS.index(_ALIKE.get(name, name)) if _ALIKE.get(name, name) in TAGS else len(TAGS) - 1 for name in [*BLOCK, *CONTROL, "#text"]}
_FIRST_TAG_BIT = len(KINDS)
# tags that say something about all that they hold
_UNDER = {name: 1 << (_FIRST_TAG_BIT + k) for k, name in enumerate(["article", "main", "nav", "aside", "header", "footer", "form", "li"])}
N_MASK = _FIRST_TAG_BIT + len(_UNDER)
_UNDER |= dict.fromkeys(CONTROL, _UNDER["form"])
_CACHE: dict[str, int] = {}


def hints(attributes: str) -> int:
    """The kinds hinted at, as bits."""
    found = _CACHE.get(attributes)
    if found is None:
        found = 0
        for m in _NAMED.finditer(attributes):
            for w in _TOKEN.findall(m[1] or m[2] or m[3] or ""):
                found |= _BIT.get(w.lower(), 0)
        if len(_CACHE) < 50_000:
            _CACHE[attributes] = found
    return found


class Page:
    """Nodes in page order: tag, parent, mask (hints and tag bits of its own), end (one past its last descendant), text and link characters."""

    __slots__ = ("tag", "parent", "mask", "under", "depth", "end", "text", "linked")

    def __init__(self) -> None:
        self.tag, self.parent, self.mask, self.under, self.depth, self.end, self.text, self.linked = [], [], [], [], [], [], [], []

    def add(self, tag: int, parent: int, mask: int, text: str = "", linked: int = 0) -> int:
        k = len(self.tag)
        self.tag.append(tag)
        self.parent.append(parent)
        self.mask.append(mask)
        self.under.append(self.under[parent] | self.mask[parent] if parent >= 0 else 0)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.end.append(k + 1)
        self.text.append(text)
        self.linked.append(linked)
        return k


def _quoted_end(source: str, at: int) -> int:
    """The place of the > that ends a tag, outside of quotes; -1 if there is none."""
    while m := _STOP.search(source, at):
        if m[0] == ">":
            return m.start()
        at = source.find(m[0], m.end()) + 1
        if not at:
            return -1
    return -1


def read(source: str) -> Page:
    """The page's nodes, in time linear in the source.

    Where the quotes of a tag swallow the rest of the page, that tag and those after it end at the next >, quoted or not.
    """
    page = Page()
    top, leaf = page.add(TAG_AT["html"], -1, 0), TAG_AT["#text"]
    stack: list[list] = [["html", top, 0]]  # open blocks: name, node, open links in it
    opened: dict[str, int] = {}
    pieces: list[str] = []
    links = linked = 0
    control: tuple[str, str, int, int] | None = None  # an open control: name, attributes, the block's number of pieces and linked characters so far

    def put(parent: int, first: int = 0) -> None:
        """Makes the pieces from the first on a run of text."""
        nonlocal linked
        if len(pieces) > first:
            text = _SPACE.sub(" ", html.unescape("".join(pieces[first:]))).strip("\x20\t\n\x0b\x0c\r")
            if text:
                page.add(leaf, parent, 0, text, min(linked, len(text)))
            del pieces[first:]
        linked = 0

    def release() -> None:
        """Ends an open control: its text becomes a node, and the block's text goes on."""
        nonlocal control, linked
        if control:
            name, attributes, first, count = control
            if len(pieces) > first:
                node = page.add(TAG_AT[name], stack[-1][1], hints(attributes) | _UNDER[name])
                put(node, first)
                page.end[node] = len(page.tag)
            pieces.append(" ")
            linked, control = count, None

    def close(upto: int) -> None:
        """Close the open blocks from place upto of the stack on."""
        nonlocal links
        put(stack[-1][1])
        while len(stack) > upto:
            name, node, count = stack.pop()
            page.end[node] = len(page.tag)
            opened[name] -= 1
            links -= count

    at, begin, size, quoted, last, absent = 0, 0, len(source), True, source.rfind(">"), set()
    while 0 <= (at := source.find("<", at)) < last:
        m, kind = _NAME.match(source, at + 1), source[at + 1]
        if m:
            end = _quoted_end(source, m.end()) if quoted else -1
            if end < 0:
                quoted, end = False, source.find(">", m.end())
        elif source.startswith("!--", at + 1):
            end = source.find("-->", at + 4)
            end = size - 1 if end < 0 else end + 2
        elif kind in "!?/":
            end = source.find(">", at)
        else:
            at += 1
            continue
        if at > begin:
            pieces.append(source[begin:at])
            linked += at - begin if links else 0
        at = begin = end + 1
        if not m:
            continue
        name, attributes = m[2].lower(), source[m.end() : end]
        if m[1]:
            if name in CONTROL:
                if control and control[0] == name:
                    release()
            elif name in BLOCK and not (control and name in OPTIONS):
                if opened.get(name):
                    release()
                    close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name))
            elif name == "a" and stack[-1][2]:
                stack[-1][2] -= 1
                links -= 1
        elif name in RAW or name in INERT:
            if not attributes.endswith("/") and name not in absent:
                done = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
                if done:
                    at = begin = done.end()
                elif name in RAW:
                    at = begin = size
                else:
                    absent.add(name)
            pieces.append(" ")
        elif name in VOID:
            if name == "hr":
                release()
                put(stack[-1][1])
            elif name in ("br", "wbr") and pieces:
                pieces.append(" ")
        elif name in CONTROL:
            release()
            control, linked = (name, attributes, len(pieces), linked), 0
        elif name in BLOCK:
            if name == "html":
                page.mask[top] |= hints(attributes)
                continue
            if control and name in OPTIONS:
                pieces.append(" ")
                continue
            release()
            if name in CLOSES and any(opened.get(x) for x in CLOSES[name][0]):
                names, stop = CLOSES[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in names:
                        close(k)
                        break
                    if stack[k][0] in stop:
                        break
            if stack[-1][0] == "p":  # a block ends an open paragraph
                close(len(stack) - 1)
            put(stack[-1][1])
            node = page.add(TAG_AT[name], stack[-1][1], (hints(attributes) if attributes else 0) | _UNDER.get(name, 0))
            stack.append([name, node, 0])
            opened[name] = opened.get(name, 0) + 1
        elif name == "a":
            stack[-1][2] += 1
            links += 1
    if begin < size:
        pieces.append(source[begin:])
        linked += size - begin if links else 0
    release()
    close(1)
    page.end[top] = len(page.tag)
    return page
