"""Web pages as trees of blocks, and the binary features of their nodes.

A node is a block element or a *leaf*: a run of text between block boundaries. Inline elements
(links, emphasis) belong to the leaf around them. Broken markup is read as browsers do in the main:
missing end tags are implied, stray ones ignored, unclosed comments and scripts reach to the end,
and elements nested deeper than ``DEEPEST`` count as siblings. Every scan moves forward, so the time
grows with the page's length.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Depth beyond which elements aren't nested any more; their text stays.
DEEPEST = 512

# Element names by their role in the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe noscript noembed noframes xmp title textarea svg math select button object audio video canvas".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot "
    "th thead tr ul caption".split())
KEEPS_P = frozenset("html head body td th tr tbody thead tfoot option optgroup".split())
#: A start tag closes an open element of the first set unless one of the second lies between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
LANDMARKS = frozenset("nav header footer aside form dialog search".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption summary".split())
TAGS = (
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li table tr td th nav header footer aside form blockquote pre figure "
    "figcaption dl dd dt details summary dialog address fieldset menu").split()
#: Words in class, id and role that say what an element is for.
PURPOSES = {
    "content": "article content post entry story body text main prose page read copy blog news single wysiwyg richtext paragraph lead",
    "title": "title headline heading hed subtitle",
    "navigation": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumb pagination pager tabs toc skip links sitemap topbar toolbar",
    "header": "header masthead banner hero logo brand branding top site",
    "footer": "footer foot colophon bottom copyright legal imprint contentinfo credits",
    "sidebar": "sidebar side aside rail widget widgets complementary secondary column related recommended recommendations trending popular more teaser",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog privacy warning message toast paywall",
    "advert": "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner commercial dfp",
    "comments": "comment comments commentlist reply replies respond discussion disqus thread feedback review reviews reader readers remark",
    "social": "share sharing social follow facebook twitter like likes rating",
    "form": "form search searchform login signin signup register subscribe subscription newsletter contact input",
    "meta": "meta byline author date time tags tag category categories info timestamp published",
}
PURPOSE_OF = {}
for _purpose, _words in PURPOSES.items():
    for _word in _words.split():
        PURPOSE_OF.setdefault(_word, []).append(_purpose)

OPEN = re.compile(r"<([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>=]+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
TAG_END = re.compile(r"[\s/]*+>")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SENTENCE_ENDS = (".", "!", "?", "…", ":", "。", ".“", ".”", ".\"", ".»", ")")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    leaf: bool
    purposes: frozenset[str] = frozenset()
    #: What the page says about its label (training pages only).
    label: str | None = None
    hidden: bool = False
    pieces: list[str] = field(default_factory=list)
    text: str = ""
    chars: int = 0
    link_chars: int = 0
    links: int = 0
    leaves: int = 0


def purposes(value: str) -> list[str]:
    """Purposes that the words of a class, an id or a role name."""
    return [p for word in TOKEN.findall(value[:1000]) for p in PURPOSE_OF.get(word.lower(), ())]


class Reader:
    """Reads one page into ``nodes``; node 0 is the document."""

    def __init__(self) -> None:
        self.nodes = [Node("html", -1, False)]
        #: (tag, node or -1 for inline elements)
        self.stack: list[tuple[str, int]] = [("html", 0)]
        self.open_tags: dict[str, int] = {"html": 1}
        self.links = 0
        self.leaf = -1
        self.inline: tuple[set[str], bool] | None = None

    def block(self) -> int:
        return next(node for _, node in reversed(self.stack) if node >= 0)

    def text(self, value: str) -> None:
        if not value:
            return
        if self.leaf < 0:
            if value.isspace():
                return
            parent = self.block()
            self.leaf = len(self.nodes)
            marks, hidden = self.inline or (set(), False)
            self.nodes.append(Node(self.nodes[parent].tag, parent, True, frozenset(marks), hidden=hidden))
        node = self.nodes[self.leaf]
        node.pieces.append(value)
        if self.links:
            node.link_chars += len(value.strip())

    def end_leaf(self) -> None:
        if self.leaf >= 0:
            node = self.nodes[self.leaf]
            node.text = " ".join("".join(node.pieces).split())
            node.pieces, node.chars = [], len(node.text)
            self.leaf = -1
        self.inline = None

    def pop(self, at: int) -> None:
        """Close the open element at a place of the stack, with all inside it."""
        for tag, node in self.stack[at:]:
            self.open_tags[tag] -= 1
            self.links -= tag == "a"
            if node >= 0:
                self.end_leaf()
        del self.stack[at:]

    def find(self, wanted: frozenset[str] | set[str], limit: frozenset[str] | set[str]) -> int:
        """Place of the innermost open element of ``wanted``, -1 if there is none within the limit."""
        if not any(self.open_tags.get(t) for t in wanted):
            return -1
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at][0] in wanted:
                return at
            if self.stack[at][0] in limit:
                return -1
        return -1

    def start(self, tag: str, attributes: dict[str, str], closed: bool) -> None:
        if tag == "html":
            return
        named = [p for a in ("class", "id", "role", "itemprop", "aria-label") if attributes.get(a) for p in purposes(attributes[a])]
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        if tag not in BLOCK:
            if tag == "br":
                self.text(" ")
            if self.leaf < 0 and (named or hidden):
                marks, before = self.inline or (set(), False)
                self.inline = (marks | set(named), before or hidden)
            if tag == "a" and self.leaf >= 0:
                self.nodes[self.leaf].links += 1
            if tag not in VOID and not closed and len(self.stack) < DEEPEST:
                self.stack.append((tag, -1))
                self.open_tags[tag] = self.open_tags.get(tag, 0) + 1
                self.links += tag == "a"
            return
        self.end_leaf()
        if tag not in KEEPS_P and (at := self.find({"p"}, {"td", "th", "table", "button"})) > 0:
            self.pop(at)
        if tag in IMPLIED and (at := self.find(*IMPLIED[tag])) > 0:
            self.pop(at)
        if tag in VOID:
            return
        parent = self.block()
        self.nodes.append(Node(tag, parent, False, frozenset(named), attributes.get("data-label"), hidden))
        if len(self.stack) < DEEPEST:
            self.stack.append((tag, len(self.nodes) - 1))
            self.open_tags[tag] = self.open_tags.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_leaf()
        elif self.leaf < 0:
            self.inline = None
        if tag in ("html", "body") or not self.open_tags.get(tag):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at][0] == tag:
                if tag in BLOCK or all(node < 0 for _, node in self.stack[at:]):
                    self.pop(at)
                else:
                    # An inline end tag doesn't close blocks; the element just ends.
                    del self.stack[at]
                    self.open_tags[tag] -= 1
                    self.links -= tag == "a"
                return


def attributes_at(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """(attributes, whether it closes itself, place after it) of a start tag from after its name."""
    found: dict[str, str] = {}
    while True:
        if m := TAG_END.match(page, at):
            return found, "/" in m.group(), m.end()
        if not (m := ATTRIBUTE.match(page, at)):
            # Only a lone sign such as "=" is left before the next attribute, or the page ends.
            at += 1
            if at >= len(page):
                return found, False, len(page)
            continue
        value = next((g for g in m.groups()[1:] if g is not None), "")
        found.setdefault(m.group(1).lower(), value)
        at = m.end()


def read(page: str) -> list[Node]:
    """The nodes of a page, parents before children, leaves in page order."""
    reader, at, end = Reader(), 0, len(page)
    no_more: set[str] = set()
    while at < end:
        sign = page.find("<", at)
        if sign < 0:
            reader.text(html.unescape(page[at:]))
            break
        if sign > at:
            reader.text(html.unescape(page[at:sign]))
        head = page[sign + 1 : sign + 4]
        if head == "!--":
            close = page.find("-->", sign + 4)
            at = end if close < 0 else close + 3
        elif head[:1] in ("!", "?") or (head[:1] == "/" and not head[1:2].isalpha()):
            close = page.find(">", sign)
            at = end if close < 0 else close + 1
        elif head[:1] == "/":
            close = page.find(">", sign)
            if close < 0:
                break
            reader.end(re.split(r"[\s/>]", page[sign + 2 : min(close, sign + 60)], maxsplit=1)[0].lower())
            at = close + 1
        elif m := OPEN.match(page, sign):
            tag = m.group(1).lower()
            attributes, closed, at = attributes_at(page, m.end())
            if tag in RAW:
                if closed and tag in ("svg", "math"):
                    continue
                found = None if tag in no_more else re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                if found is None:
                    no_more.add(tag)
                    if tag in ("script", "style", "textarea", "title", "xmp"):
                        break
                    continue
                close = page.find(">", found.end())
                at = end if close < 0 else close + 1
            else:
                reader.start(tag, attributes, closed)
        else:
            reader.text("<")
            at = sign + 1
    reader.pop(1)
    reader.end_leaf()
    nodes = reader.nodes
    for node in reversed(nodes[1:]):
        above = nodes[node.parent]
        above.chars += node.chars
        above.link_chars += min(node.link_chars, node.chars)
        above.links += node.links
        above.leaves += 1 if node.leaf else node.leaves
    return nodes


def _step(value: float, steps: tuple[float, ...]) -> int:
    return sum(value >= s for s in steps)


_NUMBERS: dict[str, int] = {}


def _names() -> list[str]:
    places = [f"{kind} {tag}" for kind in ("leaf", "element") for tag in [*TAGS, "other"]]
    named = [f"{kind} {where} {p}" for kind in ("leaf", "element") for where in ("own", "above") for p in [*PURPOSES, "hidden"]]
    within = [f"{kind} within {t}" for kind in ("leaf", "element") for t in ("article", "main", *sorted(LANDMARKS))]
    sizes = [
        *(f"leaf chars {i}" for i in range(6)), *(f"leaf words {i}" for i in range(4)), *(f"leaf links {i}" for i in range(4)),
        *(f"element links {i}" for i in range(4)), *(f"element chars {i}" for i in range(6)), *(f"element mean {i}" for i in range(5)),
        *(f"element share {i}" for i in range(4)), *(f"leaf of longest {i}" for i in range(4)), *(f"leaf beside {i}" for i in range(4))]
    signs = ["leaf", "element", "leaf ends", "leaf comma", "leaf copyright", "leaf before the first long one", "leaf after the last long one", "leaf all in links"]
    return [*places, *named, *within, *sizes, *signs]


NAMES = _names()
_NUMBERS.update({n: i for i, n in enumerate(NAMES)})
#: Kinds of edges, by the child.
LEAF_EDGE, TEXT_EDGE, CONTAINER_EDGE, LANDMARK_EDGE = range(4)


def edge_kinds(nodes: list[Node]) -> list[int]:
    return [
        LEAF_EDGE if n.leaf else TEXT_EDGE if n.tag in TEXTUAL else LANDMARK_EDGE if n.tag in LANDMARKS else CONTAINER_EDGE for n in nodes]


def features(nodes: list[Node]) -> list[list[int]]:
    """Numbers of the features that hold for each node."""
    number, out = _NUMBERS, []
    above: list[frozenset[str]] = []
    longest = max((n.chars for n in nodes if n.leaf), default=0)
    long_ones = [i for i, n in enumerate(nodes) if n.leaf and n.chars >= 100 and 2 * n.link_chars < n.chars]
    first, last = (long_ones[0], long_ones[-1]) if long_ones else (-1, len(nodes))
    whole = max(nodes[0].chars, 1)
    for i, n in enumerate(nodes):
        inherited: frozenset[str] = frozenset()
        if n.parent >= 0:
            over = nodes[n.parent]
            inherited = above[n.parent]
            own = {f"above {p}" for p in over.purposes}
            if over.hidden:
                own.add("above hidden")
            if over.tag in LANDMARKS or over.tag in ("article", "main"):
                own.add(f"within {over.tag}")
            if own - inherited:
                inherited |= own
        above.append(inherited)
        kind = "leaf" if n.leaf else "element"
        names = [kind, f"{kind} {n.tag if f'{kind} {n.tag}' in number else 'other'}"]
        names += [f"{kind} own {p}" for p in n.purposes]
        names += [f"{kind} {x}" for x in inherited]
        if n.hidden:
            names.append(f"{kind} own hidden")
        share = n.link_chars / max(n.chars, 1)
        names.append(f"{kind} links {_step(share, (0.05, 0.4, 0.8))}")
        if n.leaf:
            words = n.text.count(" ") + 1
            names += [
                f"leaf chars {_step(n.chars, (15, 40, 80, 160, 400))}", f"leaf words {_step(words, (3, 8, 20))}",
                f"leaf of longest {_step(n.chars / max(longest, 1), (0.05, 0.2, 0.6))}",
                f"leaf beside {_step((nodes[n.parent].chars - n.chars) / max(n.chars, 1), (0.01, 1, 10))}"]
            if n.text.endswith(SENTENCE_ENDS):
                names.append("leaf ends")
            if "," in n.text or "，" in n.text:
                names.append("leaf comma")
            if "©" in n.text or "copyright" in n.text[:200].lower():
                names.append("leaf copyright")
            if share > 0.95:
                names.append("leaf all in links")
            if i < first:
                names.append("leaf before the first long one")
            if i > last:
                names.append("leaf after the last long one")
        else:
            names += [
                f"element chars {_step(n.chars, (1, 40, 160, 600, 2000))}", f"element mean {_step(n.chars / max(n.leaves, 1), (15, 40, 80, 160))}",
                f"element share {_step(n.chars / whole, (0.05, 0.3, 0.7))}"]
        out.append([number[x] for x in names])
    return out
