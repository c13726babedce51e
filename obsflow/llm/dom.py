"""A small HTML reader: element nodes with attribute tokens, and the text that stands in them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# attributes by the rules of the HTML standard: a quote opens a value only right after an equals sign
_PART = r"[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++)?+)?+"
_TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)((?:{_PART})*+)>")
_CUT_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")  # a quoted value that never ends: the tag ends at its first >
_OTHER = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?=[^a-zA-Z]))[^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"[\s/]++|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))?+)?+")
_WORD = re.compile(r"[a-z]+")
# fixed values of HTML
RAW = frozenset(["script", "style", "title", "textarea", "iframe", "noembed", "noframes"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
# besides script, style and what is never shown: form controls; all else is left to the trees
UNSEEN = frozenset("head template select button datalist".split())
_NAMED = frozenset(["class", "id", "role", "itemprop", "aria-label"])
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "body": ("head",),
}
_FENCE = frozenset("table ul ol dl td th body html select".split())


@dataclass
class Page:
    """Nodes in page order, node 0 above all; each text with the node it stands in and whether a block starts or ends before it."""

    tag: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    tokens: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    texts: list[tuple[int, str, bool]] = field(default_factory=list)


def attribute_tokens(attributes: str) -> tuple[str, ...]:
    """Words of class, id, role, itemprop and aria-label; the word hidden for what is not shown."""
    found: list[str] = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in _NAMED:
            found += _WORD.findall("".join(values).lower())
        elif name == "hidden" or (name == "aria-hidden" and "true" in values):
            found.append("hidden")
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", "".join(values).lower()):
            found.append("hidden")
    return tuple(found)


def parse(source: str) -> Page:
    page = Page()
    open_nodes = [0]
    at, broke, unseen = 0, True, 0
    n = len(source)
    tag, parent, depth, tokens, texts = page.tag, page.parent, page.depth, page.tokens, page.texts

    def text(value: str) -> None:
        nonlocal broke
        if value and not unseen:
            texts.append((open_nodes[-1], html.unescape(value) if "&" in value else value, broke))
            broke = False

    def close_to(k: int) -> None:
        nonlocal broke, unseen
        for node in open_nodes[k:]:
            broke = broke or tag[node] in BLOCK
            unseen -= tag[node] in UNSEEN
        del open_nodes[k:]

    while at < n:
        found = source.find("<", at)
        if found < 0:
            text(source[at:])
            break
        text(source[at:found])
        match = _TAG.match(source, found)
        if not match:
            other = _OTHER.match(source, found)
            if other:
                at = other.end()
                continue
            match = _CUT_TAG.match(source, found)
        if not match:
            if re.match(r"</?[a-zA-Z]", source[found : found + 3]):  # a tag that the page's end cuts off
                break
            text("<")
            at = found + 1
            continue
        at, name = match.end(), match[2]
        name = name.lower()
        if match[1]:
            k = len(open_nodes) - 1
            while k > 0 and tag[open_nodes[k]] != name:
                if name not in BLOCK and tag[open_nodes[k]] in BLOCK:
                    k = 0  # an inline end tag does not close the blocks around it
                    break
                k -= 1
            if k > 0:
                close_to(k)
            elif name in BLOCK:
                broke = True
            continue
        if name == "br" or name == "hr":
            if name == "hr":
                broke = True
            text(" ")
            continue
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I).search(source, at)
            at = end.end() if end else n
            continue
        if name in VOID:
            continue
        if name in BLOCK:
            broke = True
            for k in range(len(open_nodes) - 1, 0, -1):  # a block ends an open paragraph
                if tag[open_nodes[k]] == "p":
                    close_to(k)
                    break
                if tag[open_nodes[k]] in BLOCK:
                    break
        for other in CLOSES.get(name, ()):
            for k in range(len(open_nodes) - 1, 0, -1):
                if tag[open_nodes[k]] == other:
                    close_to(k)
                    break
                if tag[open_nodes[k]] in _FENCE and tag[open_nodes[k]] not in CLOSES[name]:
                    break
        tag.append(name)
        parent.append(open_nodes[-1])
        depth.append(len(open_nodes))
        tokens.append(attribute_tokens(match[3]) if match[3] else ())
        if not match[3].rstrip().endswith("/") or name in BLOCK:
            open_nodes.append(len(tag) - 1)
            unseen += name in UNSEEN
    return page
