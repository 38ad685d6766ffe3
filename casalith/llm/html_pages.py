"""Made-up pages with known main text, for fitting the classifier of html_text. Deterministic: a seed gives the same pages."""

from __future__ import annotations

import random

#: Names that page authors give to parts of a page, by part.
NAMES = {
    "nav": ("nav", "navbar", "menu", "main-nav", "site-navigation", "top-menu", "breadcrumbs", "breadcrumb", "pagination", "pager", "toc-links", "skip-links", "navigation"),
    "header": ("header", "site-header", "page-header", "masthead", "topbar", "top-bar", "branding", "logo"),
    "footer": ("footer", "site-footer", "page_footer", "colophon", "bottom", "copyright", "footer-links", "legal"),
    "side": ("sidebar", "side", "aside", "sidebar-left", "widget-area", "widget", "rail", "secondary", "related", "related-posts", "recommended", "trending", "more-stories", "read-next"),
    "ad": ("ad", "ads", "advert", "advertisement", "ad-slot", "adbox", "banner-ad", "sponsored", "promo", "promotion", "google-ads", "sponsor", "adsense"),
    "notice": ("cookie-banner", "cookie-notice", "notice", "consent", "gdpr", "alert", "popup", "modal", "overlay", "paywall", "announcement", "banner", "privacy-notice", "toast"),
    "form": ("newsletter", "subscribe", "signup", "search", "search-form", "login", "contact-form", "subscribe-box", "share", "share-buttons", "social", "social-links", "rating"),
    "comments": ("comments", "comment-list", "comment", "discussion", "responses", "disqus", "reader-comments", "replies", "respond", "user-comments"),
}
MAIN = ("content", "article", "post", "entry", "entry-content", "post-content", "article-body", "story", "main", "main-content", "body-text", "post-body", "text", "page-content")
PLAIN = ("wrapper", "container", "row", "col", "inner", "block", "box", "page", "site", "layout", "group", "section", "grid", "left", "center")
TAGS = {"nav": ("nav", "ul", "div"), "header": ("header", "div"), "footer": ("footer", "div"), "side": ("aside", "div", "section"), "ad": ("div", "aside", "ins", "section"),
        "notice": ("div", "section", "dialog", "aside", "p"), "form": ("form", "div", "section"), "comments": ("section", "div", "ol", "aside")}
SYLLABLES = "ta re mi on the an er st in ou ble ka zo lu pe di sha qui ver nen".split()


class Page:
    """Writes a page; marks the start tags that open a boilerplate part with data-x."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.out: list[str] = []

    def words(self, n: int) -> str:
        r, out = self.r, []
        for i in range(n):
            w = "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))
            out.append((w.capitalize() if i == 0 or out[-1].endswith(".") else w) + ("." if i == n - 1 or r.random() < 0.08 else "," if r.random() < 0.08 else ""))
        return " ".join(out)

    def attrs(self, names: tuple[str, ...], chance: float = 0.85) -> str:
        r = self.r
        if r.random() > chance:
            return ""
        name = r.choice(names)
        if r.random() < 0.2:
            name = f"{r.choice(('js', 'c', 'site', 'page', 'mod', 'x'))}-{name}"
        if r.random() < 0.2:
            name += f"-{r.randint(1, 9)}"
        return f' {r.choice(("class", "class", "id"))}="{name}"'

    def links(self, n: int, tag: str = "li") -> None:
        for _ in range(n):
            self.out.append(f'<{tag}><a href="/x">{self.words(self.r.randint(1, 4))}</a></{tag}>')

    def junk(self, kind: str) -> None:
        r = self.r
        tag = r.choice(TAGS[kind])
        named = 1.0 if tag in ("div", "section", "p", "ol", "ul") and kind != "nav" else 0.5
        hidden = r.choice((" hidden", ' style="display:none"', ' aria-hidden="true"')) if kind == "notice" and r.random() < 0.15 else ""
        self.out.append(f"<{tag}{self.attrs(NAMES[kind], named)}{hidden} data-x>")
        if kind == "nav":
            self.out.append("<ul>" if tag != "ul" else "")
            self.links(r.randint(2, 9))
            self.out.append("</ul>" if tag != "ul" else "")
        elif kind == "comments":
            if r.random() < 0.5:
                self.out.append(f"<h3>{self.words(2)}</h3>")
            for _ in range(r.randint(1, 6)):
                t = r.choice(("div", "article", "li", "p"))
                inner = self.words(r.randint(3, 50))
                self.out.append(f'<{t}{self.attrs(NAMES["comments"], 0.7)}>' + (f"<b>{self.words(1)}</b> {inner}" if t == "p" else f"<span>{self.words(1)}</span><p>{inner}</p>") + f"</{t}>")
        elif kind == "form":
            self.out.append(f"<label>{self.words(2)}</label><input type=text><button>{self.words(1)}</button>" + (f"<p>{self.words(8)}</p>" if r.random() < 0.5 else ""))
        elif kind == "side":
            for _ in range(r.randint(1, 3)):
                self.out.append(f"<h4>{self.words(2)}</h4><ul>")
                self.links(r.randint(2, 6))
                self.out.append("</ul>" + (f"<p>{self.words(r.randint(5, 30))}</p>" if r.random() < 0.5 else ""))
        else:
            body = ("&copy; x.example.com &middot; " if kind == "footer" and r.random() < 0.5 else "") + self.words(r.randint(2, 30))
            self.out.append(body if r.random() < 0.4 else f"<p>{body}</p>")
            if r.random() < 0.5:
                self.links(r.randint(1, 4), r.choice(("span", "div")))
        self.out.append(f"</{tag}>")

    def article(self) -> None:
        r = self.r
        tag = r.choice(("article", "article", "main", "div", "div", "section"))
        self.out.append(f"<{tag}{self.attrs(MAIN, 0.4 if tag in ('article', 'main') else 0.9)}>")
        if r.random() < 0.8:
            head = f"<h1>{self.words(r.randint(2, 10))}</h1>"
            self.out.append(f"<header>{head}</header>" if r.random() < 0.1 and tag == "article" else head)
        inner = r.random() < 0.2
        if inner:
            self.out.append(f"<div{self.attrs(MAIN, 0.7)}>")
        for _ in range(r.choice((0, 1, 1, 1, 2, 3, 5, 8, 14))):
            x = r.random()
            text = self.words(r.choice((1, 4, 15, 40, 90)))
            if x < 0.65:
                self.out.append(r.choice((f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}</b></p>", f'<p>{text} <a href="/y">{self.words(2)}</a> {self.words(5)}</p>', f"<div><p>{text}</p></div>")))
            elif x < 0.75:
                self.out.append(f"<h2>{self.words(3)}</h2>")
            elif x < 0.82:
                self.out.append("<ul>" + "".join(f"<li>{self.words(r.randint(2, 20))}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif x < 0.88:
                self.out.append(f"<blockquote>{text}</blockquote>")
            elif x < 0.92:
                self.out.append(f"<figure><img src=x><figcaption>{self.words(6)}</figcaption></figure>")
            elif x < 0.95:
                self.out.append(f"<table><tr><td>{self.words(2)}</td><td>{self.words(3)}</td></tr></table>")
            else:
                self.junk(r.choice(("ad", "ad", "form", "side")))
        if inner:
            self.out.append("</div>")
        if r.random() < 0.12:
            self.junk("comments")
        self.out.append(f"</{tag}>")

    def write(self) -> str:
        r = self.r
        depth = r.randint(0, 3)
        for kind in ("notice", "header", "nav", "ad"):
            if r.random() < 0.5:
                self.junk(kind)
        for _ in range(depth):
            self.out.append(f"<div{self.attrs(PLAIN, 0.8)}>")
        for kind in ("nav", "side", "ad", "notice", "form"):
            if r.random() < 0.2:
                self.junk(kind)
        self.article()
        for kind in ("comments", "side", "ad", "form", "nav"):
            if r.random() < 0.3:
                self.junk(kind)
        self.out.append("</div>" * depth)
        for kind in ("side", "footer", "notice"):
            if r.random() < 0.6:
                self.junk(kind)
        return f"<html><body>{''.join(self.out)}</body></html>"
