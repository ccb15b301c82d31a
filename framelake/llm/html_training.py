"""Labelled pages for the extraction model, written from a rule.

``data-gold`` marks what an element holds: "1" main text, "0" anything else; the
nearest mark counts.  Pages vary in layout, names, block sizes and order, and text
says little about its label: adverts and comments have whole sentences, articles
have one-word paragraphs, lists, tables and links.
"""

from __future__ import annotations

import random

SYLLABLES = "an be co da el fi gu ha in jo ka lo mu ne or pi qua re si ta un ve wo ya zu".split()

#: Names that web pages give to areas, by kind.
MENU_NAMES = "nav menu navbar navigation topnav main-nav site-nav breadcrumb breadcrumbs toc pagination pager skip-links tabs".split()
HEADER_NAMES = "header site-header masthead top topbar banner-top logo branding page-header head".split()
FOOTER_NAMES = "footer site-footer bottom colophon legal copyright footer-links foot imprint credits".split()
SIDE_NAMES = "sidebar side aside widget widgets rail right-column related related-posts recommended trending popular more-stories also-read tags categories archive".split()
NOTICE_NAMES = "notice cookie cookies cookie-banner consent gdpr alert alert-info warning message disclaimer popup modal overlay announcement subscribe newsletter paywall signup toast update-notice".split()
ADVERT_NAMES = "ad ads advert advertisement adsense banner sponsor sponsored promo promotion commercial ad-box ad-slot ad-container dfp partner teaser affiliate".split()
SHARE_NAMES = "share social social-share sharing follow buttons toolbar byline-tools print actions".split()
COMMENT_NAMES = "comments comment comment-list comment-body commentlist discussion replies reply responses disqus reader-comments user-comment feedback respond guestbook".split()
FORM_NAMES = "search search-form login login-form contact contact-form subscribe-form signup-form poll survey".split()
MAIN_NAMES = "content main article post entry story post-content entry-content article-body story-body main-content text body-text page-content blog-post hentry single".split()


class Writer:
    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def some(self, items):
        return self.random.choice(items)

    def chance(self, p: float) -> bool:
        return self.random.random() < p

    def words(self, low: int, high: int) -> str:
        n = self.random.randint(low, high)
        out = ["".join(self.some(SYLLABLES) for _ in range(self.random.randint(1, 4))) for _ in range(n)]
        if self.chance(0.7):
            out[0] = out[0].capitalize()
        return " ".join(out) + self.some([".", ".", ".", "", "?", "!"])

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(2, 18) for _ in range(self.random.randint(low, high)))

    def text(self) -> str:
        """Any amount, whatever the label."""
        return self.some([self.words(1, 2), self.words(3, 8), self.sentences(1, 2), self.sentences(2, 6), self.sentences(5, 12)])

    def link(self) -> str:
        return f'<a href="/{self.random.randint(1, 9999)}">{self.words(1, 4)}</a>'

    def inline(self, text: str) -> str:
        if self.chance(0.25):
            cut = len(text) // 2
            tag = self.some(["b", "i", "em", "strong", "span", "code"])
            text = f"{text[:cut]}<{tag}>{text[cut:]}</{tag}>"
        if self.chance(0.12):
            text += " " + self.link()
        if self.chance(0.08):
            text += "<br>" + self.words(1, 6)
        return text

    def named(self, names: list[str], tags: list[str], inner: str, gold: int) -> str:
        tag = self.some(tags)
        if tag in ("div", "section", "ul", "ol", "span", "p") or self.chance(0.5):
            name = self.some(names)
            if self.chance(0.2):
                name += " " + self.some(["box", "wrap", "clearfix", "module", "item", "block", "inner", "x1", "row"])
            attribute = self.some(["class", "class", "class", "id"])
            return f'<{tag} {attribute}="{name}" data-gold="{gold}">{inner}</{tag}>'
        return f'<{tag} data-gold="{gold}">{inner}</{tag}>'

    def paragraphs(self, low: int = 1, high: int = 3) -> str:
        tag = self.some(["p", "p", "p", "div"])
        return "".join(f"<{tag}>{self.inline(self.text())}</{tag}>" for _ in range(self.random.randint(low, high)))

    def links(self) -> str:
        n = self.random.randint(2, 7)
        if self.chance(0.7):
            return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + "</ul>"
        return self.some([" | ", " ", " &middot; "]).join(self.link() for _ in range(n))

    def loose(self) -> str:
        """Text that stands in its element without a paragraph."""
        return self.some([self.text(), self.paragraphs(), f"<h3>{self.words(1, 4)}</h3>" + self.paragraphs()])

    def menu(self) -> str:
        return self.named(MENU_NAMES, ["nav", "nav", "div", "ul", "menu"], self.links(), 0)

    def header(self) -> str:
        inner = self.some([f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(1, 8)}</p>", self.link(), self.words(1, 4)]) + (self.menu() if self.chance(0.4) else "")
        return self.named(HEADER_NAMES, ["header", "header", "div"], inner, 0)

    def footer(self) -> str:
        inner = self.some([f"&copy; {self.words(1, 3)} &middot; {self.text()}", self.paragraphs(1, 2), self.links(), f"<p>Copyright {self.words(2, 6)}</p>"])
        return self.named(FOOTER_NAMES, ["footer", "footer", "div"], inner, 0)

    def side(self) -> str:
        inner = self.some([self.links(), self.loose(), f"<h3>{self.words(1, 3)}</h3>" + self.links(), f"<h4>{self.words(1, 3)}</h4>" + self.paragraphs()])
        return self.named(SIDE_NAMES, ["aside", "aside", "div", "section"], inner, 0)

    def notice(self) -> str:
        inner = self.loose() + (f"<button>{self.words(1, 2)}</button>" if self.chance(0.3) else "")
        if self.chance(0.1):
            return f'<div role="{self.some(["alert", "dialog", "banner", "status"])}" data-gold="0">{inner}</div>'
        return self.named(NOTICE_NAMES, ["div", "div", "section", "p", "aside"], inner, 0)

    def advert(self) -> str:
        return self.named(ADVERT_NAMES, ["div", "div", "section", "aside", "p"], self.some([self.loose(), self.link(), self.text()]), 0)

    def share(self) -> str:
        return self.named(SHARE_NAMES, ["div", "ul", "p"], self.links(), 0)

    def form(self) -> str:
        inner = f'<label>{self.words(1, 3)}</label><input name="q"><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select><button>{self.words(1, 2)}</button>'
        inner = (f"<p>{self.text()}</p>" if self.chance(0.5) else "") + inner
        return f'<form action="/{self.some(FORM_NAMES)}" data-gold="0">{inner}</form>' if self.chance(0.5) else self.named(FORM_NAMES, ["form", "div"], f"<form>{inner}</form>", 0)

    def comments(self) -> str:
        n = self.random.randint(1, 4)
        one = lambda: self.some(
            [
                f'<div class="{self.some(COMMENT_NAMES)}"><b>{self.words(1, 2)}</b>{self.paragraphs(1, 2)}</div>',
                f"<article>{self.paragraphs(1, 2)}</article>",
                f"<li><p>{self.text()}</p></li>",
                f"<p>{self.text()}</p>",
            ]
        )
        head = f"<{self.some(['h2', 'h3', 'h4'])}>{self.words(1, 3)}</h3>" if self.chance(0.6) else ""
        return self.named(COMMENT_NAMES, ["section", "div", "div", "ol", "aside"], head + "".join(one() for _ in range(n)), 0)

    def article_part(self) -> str:
        kind = self.random.random()
        if kind < 0.68:
            return f"<p>{self.inline(self.text())}" + ("</p>" if self.chance(0.9) else "")
        if kind < 0.76:
            return f"<{self.some(['h2', 'h3', 'h4'])}>{self.words(1, 6)}</h2>"
        if kind < 0.83:
            tag = self.some(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{self.inline(self.text())}</li>" for _ in range(self.random.randint(1, 5))) + f"</{tag}>"
        if kind < 0.88:
            return f"<blockquote>{self.paragraphs(1, 2)}</blockquote>"
        if kind < 0.92:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(2)) + "</table>"
        if kind < 0.95:
            return f"<pre>{self.words(2, 10)}</pre>"
        if kind < 0.98:
            return f"<figure><img src=x><figcaption>{self.words(2, 9)}</figcaption></figure>"
        return f"<div>{self.inline(self.text())}</div>"

    def intruder(self) -> str:
        return self.some([self.advert, self.advert, self.notice, self.side, self.share, self.form, self.menu, self.comments])()

    def article(self) -> str:
        parts = [self.article_part() for _ in range(self.random.randint(1, 12))]
        title = f"<h1>{self.words(1, 9)}</h1>"
        if self.chance(0.75):
            parts.insert(0, f"<header>{title}</header>" if self.chance(0.1) else title)
        for _ in range(self.some([0, 0, 1, 1, 2])):
            parts.insert(self.random.randint(0, len(parts)), self.intruder())
        inner = "".join(parts)
        kind = self.random.random()
        if kind < 0.4:
            inner = f'<article data-gold="1">{inner}</article>'
        elif kind < 0.55:
            inner = f'<main data-gold="1">{inner}</main>'
        elif kind < 0.65:
            inner = f'<main><article data-gold="1">{inner}</article></main>'
        else:
            inner = self.named(MAIN_NAMES, ["div", "div", "section", "article", "main"], inner, 1)
        if self.chance(0.25):
            inner = f'<div class="{self.some(["container", "wrapper", "page", "row", "layout", "site"])}">{inner}</div>'
        return inner

    def page(self) -> str:
        before = [x() for x in (self.header, self.menu, self.notice, self.advert, self.form, self.side) if self.chance(0.45)]
        after = [x() for x in (self.share, self.comments, self.side, self.advert, self.form, self.notice, self.menu) if self.chance(0.4)]
        self.random.shuffle(before)
        self.random.shuffle(after)
        ending = [self.footer()] if self.chance(0.85) else []
        hidden = [f'<div style="display:none" data-gold="0">{self.loose()}</div>'] if self.chance(0.1) else []
        inner = "".join([*before, self.article(), *hidden, *after, *ending])
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title><style>p{{}}</style></head><body>{inner}</body></html>"


def labelled_pages(count: int = 480, seed: int = 20) -> list[str]:
    return [Writer(seed * 100_003 + k).page() for k in range(count)]
