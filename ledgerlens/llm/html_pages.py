"""Labelled web pages for fitting the extractor: seeded random pages of common shapes.

A page is a string and the list of its nodes' labels is written into the page
itself: every element carries ``data-l`` (1 article, 0 other), which the parser
hands over as the label and never as a feature. The shapes are lists of what
sites commonly use, stated plainly below.
"""

from __future__ import annotations

import random

# Names that sites give to parts of a page.
MENU = ("nav", "menu", "navbar", "navigation", "topnav", "breadcrumb", "breadcrumbs", "main-menu", "pagination", "pager", "tabs", "toc")
HEAD = ("header", "site-header", "masthead", "top-bar", "banner", "branding", "logo", "page-header")
FOOT = ("footer", "site-footer", "copyright", "bottom", "colophon", "legal", "page-footer")
SIDE = ("sidebar", "aside", "side", "widget", "related", "recommended", "popular", "trending", "tags", "more-stories", "rail", "side-bar")
NOTICE = ("notice", "cookie", "cookie-banner", "consent", "gdpr", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "paywall", "disclaimer", "cookies", "message", "toast")
ADVERT = ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "banner-ad", "adbox", "ad-slot", "sponsor", "affiliate")
COMMENT = ("comment", "comments", "replies", "discussion", "reader-comments", "disqus", "responses", "comment-list", "comment-body", "reply", "feedback")
SHARE = ("share", "social", "sharing", "follow", "share-bar", "buttons", "social-links")
ARTICLE = ("article", "content", "post", "entry", "story", "main", "body", "text", "article-body", "entry-content", "post-content", "main-content", "story-body")
PLAIN = ("wrapper", "container", "row", "page", "inner", "col", "layout", "site", "grid", "section", "box", "block")


class Page:
    """Writes one page."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.out: list[str] = []

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join("".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high)))

    def mixed(self, low: int, high: int) -> str:
        """Words, some of them links."""
        r, how = self.r, self.r.random()
        if how < 0.5:
            return self.words(low, high)
        link = f'<a href="/z">{self.words(1, max(1, high // r.choice((1, 3, 6))))}</a>'
        return link if how < 0.6 else f"{self.words(low, high)} {link}" if how < 0.8 else f"{link} {self.words(low, high)}"

    def names(self, names) -> str:
        r, how = self.r, self.r.random()
        name = r.choice(names)
        if how < 0.55:
            return f' class="{name}"'
        if how < 0.75:
            return f' id="{name}"'
        return f' class="{name} {r.choice(PLAIN)}-{r.randint(1, 9)}"' if how < 0.9 else f' id="{name}-{r.randint(1, 99)}"'

    def open(self, tag: str, label: int, names=()) -> None:
        self.out.append(f'<{tag}{self.names(names) if names else ""} data-l="{label}">')

    def leaf(self, tag: str, label: int, text: str, names=()) -> None:
        self.open(tag, label, names)
        self.out.append(f"{text}</{tag}>")

    def links(self, label: int, n: int, tag: str = "ul") -> None:
        self.open(tag, label)
        for _ in range(n):
            self.open("li" if tag == "ul" else "p", label)
            text = f'<a href="/x">{self.words(1, 3)}</a>' if self.r.random() < 0.9 else self.words(1, 3)
            self.out.append(f'{text}</{"li" if tag == "ul" else "p"}>')
        self.out.append(f"</{tag}>")

    def other(self, kind: str) -> None:
        """A part that is not article: by its tag, by its name, or both."""
        r = self.r
        tags, names = {
            "menu": (("nav", "div", "ul", "section"), MENU), "head": (("header", "div"), HEAD),
            "foot": (("footer", "div"), FOOT), "side": (("aside", "div", "section"), SIDE),
            "notice": (("div", "section", "p", "dialog", "aside"), NOTICE), "advert": (("div", "aside", "section", "p", "ins"), ADVERT),
            "comment": (("div", "section", "ol", "ul", "article"), COMMENT), "share": (("div", "ul", "section"), SHARE),
            "form": (("form",), MENU + NOTICE + COMMENT + PLAIN),
        }[kind]
        tag = r.choice(tags)
        told = tag in ("nav", "header", "footer", "aside", "form", "dialog") and r.random() < 0.5
        self.open(tag, 0, () if told else names)
        if tag == "p":
            self.out.append(self.mixed(3, 30) + ".</p>")
            return
        if kind in ("menu", "share", "head", "foot") and tag != "ul" and r.random() < 0.3:
            self.out.append(f"{self.mixed(1, 12)}</{tag}>")  # text without blocks of its own
            return
        if kind in ("menu", "share"):
            self.links(0, r.randint(2, 9)) if tag != "ul" else [self.leaf("li", 0, f'<a href="/x">{self.words(1, 3)}</a>') for _ in range(r.randint(2, 9))]
        elif kind == "head":
            self.leaf(r.choice(("h1", "p", "div", "h2")), 0, self.mixed(1, 6))
            if r.random() < 0.4:
                self.links(0, r.randint(2, 6))
            elif r.random() < 0.5:
                self.out.append(" ".join(f'<a href="/x">{self.words(1, 2)}</a>' for _ in range(r.randint(1, 5))))
        elif kind == "foot":
            self.leaf(r.choice(("p", "p", "div", "h4")), 0, "&copy; " * (r.random() < 0.5) + self.mixed(2, 20))
            if r.random() < 0.5:
                self.links(0, r.randint(2, 6))
        elif kind == "comment":
            for _ in range(r.randint(1, 6)):
                inner = "li" if tag in ("ol", "ul") else r.choice(("div", "p", "article"))
                self.open(inner, 0, COMMENT if r.random() < 0.5 and inner != "p" else ())
                if inner == "p":
                    self.out.append(self.mixed(3, 60) + ".</p>")
                else:
                    self.leaf("p", 0, self.mixed(3, 60) + ".")
                    self.out.append(f"</{inner}>")
        elif kind == "form":
            self.leaf("label", 0, self.words(1, 4))
            self.out.append(f'<input type="text"><button data-l="0">{self.words(1, 2)}</button>')
            if r.random() < 0.5:
                self.leaf("p", 0, self.words(3, 15))
        elif kind == "side":
            self.leaf(r.choice(("h2", "h3", "h4")), 0, self.words(1, 4))
            self.links(0, r.randint(2, 6)) if r.random() < 0.6 else self.leaf("p", 0, self.mixed(4, 40) + ".")
        elif r.random() < 0.5:
            self.out.append(self.mixed(3, 40) + ".")
        else:
            self.leaf("p", 0, self.mixed(3, 40) + ".")
        self.out.append(f"</{tag}>")

    def article_part(self) -> None:
        r, how = self.r, self.r.random()
        if how < 0.7:
            self.leaf("p", 1, (self.mixed if r.random() < 0.4 else self.words)(1, r.choice((3, 8, 30, 90))) + ".")
        elif how < 0.78:
            self.leaf(r.choice(("h2", "h3", "h4")), 1, self.words(1, 8))
        elif how < 0.86:
            tag = r.choice(("ul", "ol"))
            self.open(tag, 1)
            linked = r.random()
            for _ in range(r.randint(1, 5)):  # some lists of an article are links to what it names
                text = self.words(2, 20) if linked < 0.7 else self.mixed(2, 12) if linked < 0.85 else f'<a href="/y">{self.words(1, 6)}</a>'
                self.leaf("li", 1, text)
            self.out.append(f"</{tag}>")
        elif how < 0.9:
            self.leaf("blockquote", 1, self.words(5, 40) + ".")
        elif how < 0.93:
            self.open("table", 1)
            for _ in range(2):
                self.open("tr", 1)
                self.leaf("td", 1, self.words(1, 5))
                self.leaf("td", 1, self.words(1, 5))
                self.out.append("</tr>")
            self.out.append("</table>")
        elif how < 0.96:
            self.leaf(r.choice(("pre", "figcaption", "div", "div")), 1, self.words(3, 30))
        else:
            self.open(r.choice(("section", "div")), 1, () if r.random() < 0.6 else PLAIN + ARTICLE)
            shut = self.out[-1][1:].split()[0]
            self.leaf("h2", 1, self.words(1, 6))
            self.leaf("p", 1, self.words(5, 60) + ".")
            self.out.append(f"</{shut}>")

    def write(self) -> str:
        r = self.r
        self.open("html", 1)
        self.open("body", 1)
        depth = r.randint(0, 2)
        for _ in range(depth):
            self.open("div", 1, PLAIN if r.random() < 0.8 else ())
        for kind in ("notice", "head", "menu", "advert", "form", "share"):
            if r.random() < (0.5 if kind in ("head", "menu") else 0.3):
                self.other(kind)
        body = r.choice(("article", "main", "div", "section", "both", "none"))
        tags = {"both": ("main", "article"), "none": ()}.get(body, (body,))
        for tag in tags:
            self.open(tag, 1, ARTICLE if r.random() < (0.6 if tag in ("div", "section") else 0.4) else ())
        if r.random() < 0.8:
            self.leaf("h1", 1, self.words(1, 10))
        for _ in range(r.randint(0, 9)):
            self.article_part()
            if r.random() < 0.1:
                self.other(r.choice(("advert", "share", "side", "notice", "form", "menu")))
        if r.random() < 0.15:
            self.other("comment")
        self.out += [f"</{t}>" for t in reversed(tags)]
        for kind in ("comment", "side", "share", "form", "advert", "notice", "menu", "foot"):
            if r.random() < (0.6 if kind == "foot" else 0.3):
                self.other(kind)
        self.out += ["</div>"] * depth + ["</body></html>"]
        return "".join(self.out)


def labelled_pages(n: int, seed: int = 7) -> list[str]:
    return [Page(seed * 1_000_003 + i).write() for i in range(n)]
