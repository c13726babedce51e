"""Labelled training pages, made from a grammar of page parts: no labelled pages are at hand.

Each part is (html, wanted). Wanted parts are the article's title, paragraphs, lists, quotes, tables and figures;
the others are menus, headers, footers, sidebars, notices, adverts, forms and reader comments, both beside the article
and inside it. Names of classes and ids are drawn per page, and a share of the parts has none, so that a classifier
has to use structure as well. A mark in the text of every unwanted part gives the labels of its nodes.
"""

from __future__ import annotations

import numpy as np

UNWANTED = "\ue000"
# words of class and id attributes by part: fixed values
NAMES = {
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs pagination pager toc skip links mainmenu sitenav",
    "header": "header masthead topbar banner branding logo siteheader pageheader head",
    "footer": "footer foot colophon copyright legal bottom sitefooter credits",
    "aside": "sidebar aside widget related recommended trending popular recirculation more secondary rail tagcloud",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promoted promotion banner dfp outbrain taboola commercial",
    "notice": "cookie cookies consent gdpr notice alert banner popup modal overlay message warning disclaimer announcement paywall toast",
    "form": "form search searchform newsletter subscribe signup login contact register",
    "comments": "comment comments commentlist reply replies respond discussion disqus thread responses feedback usercomments",
    "share": "share sharing social socials follow buttons tools toolbar",
    "content": "article content post entry story main body text maincontent postbody articlebody entrycontent page container wrapper prose copy",
}
TAGS = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div"], "ad": ["div", "aside", "section", "ins"],
        "notice": ["div", "section", "aside", "dialog"], "form": ["form"], "comments": ["section", "div", "ol", "ul"], "share": ["div", "ul"]}


class Maker:
    def __init__(self, seed: int):
        self.random = np.random.default_rng(seed)
        letters = list("abcdefghijklmnopqrstuvwxyzéü")
        self.words = ["".join(self.random.choice(letters, self.random.integers(1, 11))) for _ in range(400)]

    def some(self, low: int, high: int) -> int:
        return int(self.random.integers(low, high + 1))

    def chance(self, p: float) -> bool:
        return bool(self.random.random() < p)

    def pick(self, values: list) -> object:
        return values[int(self.random.integers(len(values)))]

    def sentence(self, low: int, high: int, mark: str = "") -> str:
        words = [self.pick(self.words) for _ in range(self.some(low, high))]
        if self.chance(0.15):
            words = [w + str(self.pick(["", "***", "&amp;", "!!", " |"])) for w in words]
        out = " ".join(words)
        return mark + out[:1].upper() + out[1:] + str(self.pick([".", ".", ".", "", "?", ","]))

    def attributes(self, part: str) -> str:
        if self.chance(0.25):
            return ""
        name = str(self.pick(NAMES[part].split()))
        if self.chance(0.3):
            name += str(self.pick(["-", "_", " "])) + str(self.pick(["box", "wrap", "area", "block", "inner", "list", "top", "item", *NAMES[part].split()]))
        return f' {self.pick(["class", "class", "class", "id"])}="{name}"'

    def links(self, low: int, high: int) -> str:
        return "".join(f'<li><a href="/{self.pick(self.words)}">{self.sentence(1, 3, UNWANTED)}</a></li>' for _ in range(self.some(low, high)))

    def unwanted(self, part: str) -> str:
        tag = str(self.pick(TAGS[part]))
        mark = UNWANTED
        body = {
            "nav": lambda: f"<ul>{self.links(2, 9)}</ul>" if self.chance(0.7) else " ".join(f'<a href="#">{self.sentence(1, 2, mark)}</a>' for _ in range(self.some(2, 8))),
            "header": lambda: f'<a href="/">{self.sentence(1, 4, mark)}</a>' + (f"<p>{self.sentence(2, 8, mark)}</p>" if self.chance(0.5) else ""),
            "footer": lambda: f"&copy; {self.sentence(1, 9, mark)} &middot; {self.sentence(2, 12, mark)}" if self.chance(0.6) else f"<p>{self.sentence(4, 20, mark)}</p><ul>{self.links(1, 5)}</ul>",
            "aside": lambda: f"<h3>{self.sentence(1, 4, mark)}</h3>" + (f"<ul>{self.links(2, 8)}</ul>" if self.chance(0.7) else f"<p>{self.sentence(5, 40, mark)}</p>"),
            "ad": lambda: self.sentence(2, 20, mark) if self.chance(0.6) else f'<a href="#">{self.sentence(2, 8, mark)}</a><p>{self.sentence(3, 20, mark)}</p>',
            "notice": lambda: f"<p>{self.sentence(5, 40, mark)}</p>" + (f"<a href='#'>{self.sentence(1, 2, mark)}</a>" if self.chance(0.5) else ""),
            "form": lambda: f"<label>{self.sentence(1, 4, mark)}</label><input><p>{self.sentence(1, 12, mark)}</p>",
            "comments": lambda: f"<h3>{self.sentence(1, 3, mark)}</h3>" + "".join(
                (f"<li>{x}</li>" if tag in ("ol", "ul") else f"<div{self.attributes('comments')}>{x}</div>")
                for x in (f"<b>{self.sentence(1, 2, mark)}</b> <p>{self.sentence(5, 60, mark)}</p>" for _ in range(self.some(1, 6)))
            ),
            "share": lambda: " ".join(f'<a href="#">{self.sentence(1, 2, mark)}</a>' for _ in range(self.some(2, 5))),
        }[part]()
        attributes = self.attributes(part)
        if not attributes and tag in ("div", "section", "ul", "ol", "dialog", "ins") and part not in ("nav", "share"):
            attributes = f' class="{self.pick(NAMES[part].split())}"'
        return f"<{tag}{attributes}>{body}</{tag}>"

    def wanted(self) -> str:
        kind = self.random.random()
        if kind < 0.72:
            text = " ".join(self.sentence(1, 25) for _ in range(self.some(1, 8)))
            if self.chance(0.15):
                text += f' <a href="/x">{self.sentence(1, 4)}</a> {self.sentence(2, 9)}'
            if self.chance(0.12):
                tag = self.pick(["math", "object", "noscript", "svg", "map", "canvas", "video", "audio", "em", "code", "span"])
                text += f" <{tag}>{self.sentence(1, 6)}</{tag}> {self.sentence(1, 9)}"
            if self.chance(0.15):
                return f"<p><b>{text}<br>"
            return f"<p>{text}</p>" if self.chance(0.9) else f"<div>{text}</div>"
        if kind < 0.8:
            return f"<h2>{self.sentence(1, 8)}</h2>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{self.sentence(2, 20)}</li>" for _ in range(self.some(1, 6))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote><p>{self.sentence(5, 40)}</p></blockquote>"
        if kind < 0.96:
            return "<table>" + "".join(f"<tr><td>{self.sentence(1, 4)}</td><td>{self.sentence(1, 6)}</td></tr>" for _ in range(self.some(1, 5))) + "</table>"
        return f"<figure><img src=x><figcaption>{self.sentence(2, 14)}</figcaption></figure>"

    def page(self) -> str:
        body = [self.wanted() for _ in range(self.some(1, 14))]
        if self.chance(0.75):
            body.insert(0, f"<h1>{self.sentence(2, 12)}</h1>")
        for part in ("ad", "share", "aside", "form", "notice", "nav"):
            if self.chance(0.12):
                body.insert(self.some(1, len(body)), self.unwanted(part))
        if self.chance(0.2):
            body.append(self.unwanted("comments"))
        tag = str(self.pick(["article", "article", "main", "div", "div", "section"]))
        attributes = self.attributes("content") if tag != "div" else f' class="{self.pick(NAMES["content"].split())}"'
        article = f"<{tag}{attributes}>{''.join(body)}</{tag}>"
        if self.chance(0.05):
            article = f"<noscript><p>{self.sentence(4, 14, UNWANTED)}</p></noscript>" + article
        before = [self.unwanted(p) for p in ("notice", "header", "nav", "ad", "form") if self.chance(0.5)]
        after = [self.unwanted(p) for p in ("share", "aside", "comments", "ad", "nav", "form", "footer", "notice") if self.chance(0.35)]
        self.random.shuffle(before)
        inner = "".join(before) + article + "".join(after)
        if self.chance(0.4):
            inner = f"<div{self.attributes('content')}>{inner}</div>"
        end = "</body></html>" if self.chance(0.85) else ""
        return f"<!DOCTYPE html><html><head><title>{self.sentence(2, 8)}</title></head><body>{inner}{end}"


def pages(n: int, seed: int = 1) -> list[str]:
    maker = Maker(seed)
    return [maker.page() for _ in range(n)]
