"""The leaf blocks of a web page: runs of text that no block element parts, with the elements that hold them."""

from __future__ import annotations

import html as entities
import re
from collections import Counter

#: Fixed values of HTML: elements that begin a new block, that have no end, that hold no page text, and whose content is not markup.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("audio button canvas datalist iframe noembed noframes noscript object script select style svg template textarea title video".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var".split())
ENDS_P = BLOCKS - frozenset("body caption html legend summary tbody td tfoot th thead tr".split())
#: An element ends an open one of the first kind unless one of the second stands between.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    **{t: (("thead", "tbody", "tfoot"), ("table",)) for t in ("thead", "tbody", "tfoot")}, **{h: (("h1", "h2", "h3", "h4", "h5", "h6"), ("div", "section", "article", "td")) for h in ("h1", "h2", "h3", "h4", "h5", "h6")},
}
WALLS = frozenset(("table", "td", "th", "caption"))

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
_OTHER = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>="']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))|(?<=\s)(hidden)(?=[\s/>]|$)""")
_NAMED = frozenset(("class", "id", "role", "itemprop", "aria-label"))
LABEL = "data-label"


class Element:
    """One element that may hold blocks: its tag, the words of its names (class, id, role), and the label that it was given."""

    __slots__ = ("parent", "tag", "names", "label", "known")

    def __init__(self, parent, tag: str, names: str, label: str | None):
        self.parent, self.tag, self.names, self.label, self.known = parent, tag, names, label, None


class Elements:
    """Elements of the same tag and names in the same place count as one, so what is worked out of one is there for the next page."""

    def __init__(self, most: int = 50_000):
        self.root, self.most, self.seen = Element(None, "", "", None), most, {}

    def child(self, parent: Element, tag: str, attributes: str) -> Element:
        key = (parent, tag, attributes)
        found = self.seen.get(key)
        if found is None:
            names, label = [], parent.label
            if attributes and not attributes.isspace():
                for m in _ATTRIBUTE.finditer(attributes):
                    name = (m[1] or m[5]).lower()
                    value = m[2] or m[3] or m[4] or ""
                    if name in _NAMED and tag not in ("html", "body"):
                        names.append(value)
                    elif name == "hidden":
                        names.append("hidden")
                    elif name == LABEL:
                        label = value
            found = self.seen[key] = Element(parent, tag, " ".join(names), label)
        return found

    def trim(self) -> None:
        """Between pages: forget all when there are too many."""
        if len(self.seen) > self.most:
            self.seen.clear()


class Block:
    """``text`` with references decoded and white space as single spaces; ``tag`` of the block element, ``element`` that holds it, share of ``linked`` letters."""

    __slots__ = ("text", "element", "linked")

    def __init__(self, text: str, element: Element, linked: float):
        self.text, self.element, self.linked = text, element, linked


def leaf_blocks(page: str, elements: Elements) -> list[Block]:
    """The blocks of a whole page in its order. Elements that are never closed end where HTML says or with the page; what is no markup is text."""
    out: list[Block] = []
    stack: list[tuple[str, Element]] = [("", elements.root)]
    open_tags: Counter = Counter()
    parts: list[str] = []
    holder: Element | None = None
    linked = hidden = at = 0

    def flush():
        nonlocal holder, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, holder, min(1.0, linked / len(text))))
            parts.clear()
        holder, linked = None, 0

    def say(raw: str):
        nonlocal holder, linked
        if hidden or not raw:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        if holder is None:
            if text.isspace():
                return
            holder = stack[-1][1]
        parts.append(text)
        if open_tags["a"]:
            linked += len(text)

    def pop():
        nonlocal hidden
        tag, _ = stack.pop()
        open_tags[tag] -= 1
        hidden -= tag in HIDDEN

    def end(names, walls) -> None:
        """Close the nearest open element of some names, with all in it."""
        if not any(open_tags[n] for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                while len(stack) > i:
                    pop()
                return
            if stack[i][0] in walls:
                return

    last = page.rfind(">")
    while True:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        say(page[at:lt])
        tag_match = _TAG.match(page, lt) if lt < last else None
        if tag_match is None:
            other = _OTHER.match(page, lt)
            if other:
                at = other.end()
            elif lt > last and page[lt + 1 : lt + 2].isalpha():
                break  # a tag that the page's end cuts off
            else:
                say("<")
                at = lt + 1
            continue
        closing, tag, attributes, at = tag_match[1], tag_match[2].lower(), tag_match[3], tag_match.end()
        if closing:
            if tag in BLOCKS:
                flush()
                end((tag,), WALLS if tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption") else ())
            elif open_tags[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        if tag in INLINE:
                            del stack[i]
                            open_tags[tag] -= 1
                        else:
                            flush() if tag not in HIDDEN else None
                            while len(stack) > i:
                                pop()
                        break
            continue
        if tag == "br":
            say(" ") if holder is not None else None
            continue
        if tag in BLOCKS:
            flush()
            if tag in ENDS_P:
                end(("p",), WALLS)
            if tag in ENDS:
                end(*ENDS[tag])
        elif tag == "a" and open_tags["a"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "a":
                    del stack[i]
                    open_tags["a"] -= 1
                    break
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if close is None:
                break
            at = page.find(">", close.end())
            if at < 0:
                break
            at += 1
            continue
        if attributes.endswith("/") and tag not in BLOCKS and tag not in INLINE:
            continue
        if tag not in BLOCKS and tag not in INLINE and tag not in HIDDEN:
            flush()  # an element of a name of its own holds blocks
        open_tags[tag] += 1
        hidden += tag in HIDDEN
        stack.append((tag, stack[-1][1] if tag in INLINE or tag in HIDDEN else elements.child(stack[-1][1], tag, attributes)))
    flush()
    return out
