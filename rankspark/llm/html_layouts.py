"""Labelled training pages: the text of real pages laid out anew in many ways.

A page says ``data-label="1"`` where article text begins and ``"0"`` where something else does; what
lies inside inherits it. Only training reads these marks.
"""

from __future__ import annotations

import html
import random

#: Class or id names that the layouts draw from, by what they mark.
NAMES = {
    "header": ["header", "site-header", "top", "masthead", "page-header", "banner", "topbar"],
    "nav": ["nav", "menu", "navbar", "main-menu", "navigation", "nav-links", "primary-menu"],
    "crumbs": ["breadcrumb", "breadcrumbs", "crumbs"],
    "notice": ["cookie-notice", "consent", "notice", "alert", "cookie-banner", "gdpr", "popup", "message"],
    "ad": ["ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "adBox"],
    "content": ["content", "post", "entry-content", "article-body", "story", "post-content", "main-text", "articleBody", "page-content", "prose"],
    "sidebar": ["sidebar", "side", "widget", "related", "secondary", "rail", "more-stories"],
    "comments": ["comments", "comment-list", "reader-comments", "discussion", "responses", "commentSection"],
    "comment": ["comment", "reply", "comment-body", "feedback"],
    "footer": ["footer", "site-footer", "foot", "colophon", "bottom", "page-footer"],
    "form": ["search", "newsletter", "subscribe", "contact-form", "login"],
    "share": ["share", "social", "share-buttons", "follow"],
}


def invented_words(rng: random.Random, n: int) -> list[str]:
    """Words for pages that have no model."""
    sounds = ["ba", "tor", "li", "mend", "o", "sa", "ren", "ti", "ku", "val", "e", "nis"]
    return ["".join(rng.choices(sounds, k=rng.randint(1, 4))) for _ in range(n)]


def invented_article(rng: random.Random) -> list[tuple[str, str]]:
    """Blocks (tag, text) of an invented article."""
    blocks = [("h1", " ".join(invented_words(rng, rng.randint(3, 9))).capitalize())]
    for _ in range(rng.randint(1, 9)):
        blocks.append(("p", " ".join(
            " ".join(invented_words(rng, rng.randint(3, 18))).capitalize() + rng.choice([".", ".", ", etc.", "!", "?"]) for _ in range(rng.randint(1, 7)))))
    return blocks


class Layout:
    """One random page around an article."""

    def __init__(self, rng: random.Random, article: list[tuple[str, str]], words: list[str]):
        self.rng, self.article, self.words = rng, article, words or ["text"]
        self.marked = rng.random() < 0.75

    def some(self, least: int, most: int) -> str:
        return html.escape(" ".join(self.rng.choices(self.words, k=self.rng.randint(least, most))), quote=False)

    def sentence(self, least: int = 3, most: int = 20) -> str:
        return self.some(least, most).capitalize() + self.rng.choice([".", ".", "!", ""])

    def element(self, tag: str, body: str, name: str = "", label: int | None = None) -> str:
        marks = "" if label is None else f' data-label="{label}"'
        if name and self.marked:
            marks += f' {self.rng.choice(["class", "class", "class", "id"])}="{self.rng.choice(NAMES[name])}"'
        return f"<{tag}{marks}>{body}</{tag}>"

    def links(self, least: int = 2, most: int = 10) -> str:
        items = [f'<a href="/{self.some(1, 1)}">{self.some(1, 5)}</a>' for _ in range(self.rng.randint(least, most))]
        kind = self.rng.randrange(3)
        if kind == 0:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return " | ".join(items) if kind == 1 else "".join(f"<div>{i}</div>" for i in items)

    def nav(self) -> str:
        return self.element(self.rng.choice(["nav", "nav", "div", "ul"]), self.links(3, 12), "nav", 0)

    def header(self) -> str:
        inner = f"<div>{self.some(1, 4)}</div>" + (self.element("p", self.sentence(3, 9)) if self.rng.random() < 0.5 else "")
        return self.element(self.rng.choice(["header", "div"]), inner + (self.nav() if self.rng.random() < 0.5 else ""), "header", 0)

    def notice(self) -> str:
        inner = self.element("p", self.sentence(6, 40)) if self.rng.random() < 0.6 else self.sentence(6, 40)
        return self.marked_always("div", inner + "<button>OK</button>", "notice")

    def advert(self) -> str:
        inner = self.element("p", self.sentence(3, 25)) if self.rng.random() < 0.4 else self.sentence(3, 25)
        return self.marked_always(self.rng.choice(["div", "div", "aside", "section"]), inner, "ad")

    def marked_always(self, tag: str, body: str, name: str) -> str:
        """Adverts, notices and comments are told from the article by their names only, so they always have one."""
        before, self.marked = self.marked, True
        out = self.element(tag, body, name, 0)
        self.marked = before
        return out

    def sidebar(self) -> str:
        inner = self.element(self.rng.choice(["h2", "h3", "h4"]), self.some(1, 4)) + (self.links() if self.rng.random() < 0.7 else "")
        inner += "".join(self.element("p", self.sentence(5, 30)) for _ in range(self.rng.randint(0, 3)))
        return self.element("aside", inner, "sidebar", 0) if self.rng.random() < 0.5 else self.marked_always("div", inner, "sidebar")

    def comments(self) -> str:
        inner = self.element(self.rng.choice(["h2", "h3"]), self.some(1, 3))
        for _ in range(self.rng.randint(1, 5)):
            body = self.element("p", " ".join(self.sentence(4, 30) for _ in range(self.rng.randint(1, 6))))
            inner += self.element(self.rng.choice(["div", "li", "article"]), (self.element("div", self.some(1, 3)) if self.rng.random() < 0.6 else "") + body, "comment")
        if self.rng.random() < 0.4:
            inner += self.form()
        return self.marked_always(self.rng.choice(["section", "div", "ol"]), inner, "comments")

    def form(self) -> str:
        inner = self.some(1, 6) + " <input name=q> " + (f"<label>{self.some(1, 4)}</label>" if self.rng.random() < 0.6 else "")
        return self.element("form", inner + (self.element("p", self.sentence(4, 18)) if self.rng.random() < 0.5 else "") + "<button>Go</button>", "form", 0)

    def share(self) -> str:
        return self.marked_always("div", self.links(2, 4), "share")

    def footer(self) -> str:
        inner = f"&copy; {self.some(1, 3)} &middot; {self.sentence(3, 14)}" if self.rng.random() < 0.7 else self.element("p", self.sentence(3, 14))
        return self.element(self.rng.choice(["footer", "footer", "div"]), inner + (self.links() if self.rng.random() < 0.4 else ""), "footer", 0)

    def block(self, tag: str, text: str) -> str:
        rng = self.rng
        body = html.escape(text, quote=False)
        if rng.random() < 0.3 and " " in body:
            words = body.split(" ")
            at = rng.randrange(len(words))
            words[at] = rng.choice([f"<b>{words[at]}</b>", f'<a href="/{at}">{words[at]}</a>', f"<em>{words[at]}</em>", words[at] + "<br>", f"\n  {words[at]}"])
            body = " ".join(words)
        if tag == "p":
            kind = rng.random()
            if kind < 0.05:
                return f"<blockquote><p>{body}</p></blockquote>"
            if kind < 0.1:
                return f"<ul><li>{body}</li></ul>"
            if kind < 0.15:
                return f"<div>{body}</div>"
            if kind < 0.2 and "<" not in body:
                level = rng.randint(2, 4)
                return f"<h{level}>{' '.join(body.split(' ')[:5])}</h{level}><p>{body}</p>"
            if kind < 0.25:
                return f"<p>{body}"
        return f"<{tag}>{body}</{tag}>"

    def main(self) -> str:
        rng, parts = self.rng, []
        inside = [self.advert, self.share, self.form, self.sidebar, self.nav, self.notice]
        for tag, text in self.article:
            parts.append(self.block(tag, text))
            if rng.random() < 0.08:
                parts.append(rng.choice(inside)())
        if rng.random() < 0.25:
            parts.append(rng.choice([self.comments, self.share, self.footer, self.form])())
        if rng.random() < 0.1:
            parts.insert(0, self.nav())
        tag = rng.choice(["article", "article", "main", "div", "div", "section"])
        out = self.element(tag, "".join(parts), "content", 1)
        for _ in range(rng.choice([0, 0, 1, 2])):
            out = self.element(rng.choice(["div", "main", "div", "section"]), out + (self.sidebar() if rng.random() < 0.2 else ""), rng.choice(["content", ""]))
        return out

    def page(self) -> str:
        rng = self.rng
        before = [f() for f in (self.header, self.nav, self.notice, self.advert, self.form, self.sidebar) if rng.random() < 0.4]
        after = [f() for f in (self.comments, self.sidebar, self.advert, self.form, self.notice, self.footer) if rng.random() < 0.4]
        rng.shuffle(before)
        body = "".join([*before, self.main(), *after])
        if rng.random() < 0.2:
            body = self.element("div", body)
        script = "<style>p{margin:0}</style><script>var a='</p>';</script>"
        end = rng.choice(["</body></html>", ""])
        return f"<!DOCTYPE html><html><head><title>{self.some(2, 8)}</title>{script}</head><body>{body}{end}"


def layouts(seed: str, article: list[tuple[str, str]], words: list[str], n: int) -> list[str]:
    """So many pages around an article; an empty list of blocks stands for an invented one."""
    rng = random.Random(seed)
    return [Layout(rng, article or invented_article(rng), words or invented_words(rng, 60)).page() for _ in range(n)]
