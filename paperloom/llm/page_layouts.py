"""Pages of made-up layouts with known main text, to train the block labeller on.

Every page is a random tree of the parts that pages have: menus, headers, footers, sidebars,
notices, adverts, forms and reader comments around (and inside) an article. Parts vary in tags,
names, order and nesting; their words are those of the corpus, so what is learnt is layout.
"""

from __future__ import annotations

import random
from html import escape

# fixed values: names that page authors give to parts
NAMES = {
    "menu": "nav menu navbar navigation topnav main-menu mainmenu navlinks breadcrumb breadcrumbs pagination pager tabs site-nav nav-primary submenu links skip-link".split(),
    "header": "header masthead site-header topbar banner branding logo page-header site-title head top".split(),
    "footer": "footer site-footer foot bottom copyright colophon page-footer legal credits footer-links imprint".split(),
    "side": "sidebar aside widget widgets rail right-col secondary related related-posts recent-posts popular trending tags tag-cloud side side-bar column-left most-read see-also teaser recommended".split(),
    "notice": "notice cookie cookie-banner cookie-notice consent gdpr alert popup modal warning message disclaimer overlay announcement toast paywall".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adsense ad-slot adbox promoted commercial partner ad-container".split(),
    "comments": "comments comment comment-list replies discussion respond responses thread user-comments reader-comments feedback commentlist comment-body".split(),
    "form": "search search-form login signup contact-form subscribe newsletter form subscribe-form search-box".split(),
    "share": "share social social-links follow sharing share-buttons".split(),
    "main": "article content main post entry story body article-body post-content entry-content main-content text page-content story-body article-text single hentry blog-post maincontent primary post-body".split(),
    "neutral": "wrapper container row col inner grid layout page site app root outer clearfix box block section panel module wrap region".split(),
}
TAGS = {"menu": ["nav", "div", "ul", "div"], "header": ["header", "div", "div"], "footer": ["footer", "div", "div"], "side": ["aside", "div", "section"], "notice": ["div", "section", "aside", "p"], "advert": ["div", "aside", "section", "ins"], "comments": ["section", "div", "div", "aside"], "form": ["form", "div"], "share": ["div", "ul"], "main": ["article", "main", "div", "section", "td"]}


class Maker:
    """Makes pages; ``parts`` keeps (text, is main text) of the blocks in page order."""

    def __init__(self, seed: int, texts: list[str]):
        self.rng = random.Random(seed)
        words = [w for t in texts for w in t.split()[:60]]
        self.words = words or "lorem ipsum dolor sit amet".split()
        self.texts = texts or ["Lorem ipsum dolor sit amet."]

    def some(self, low: int, high: int) -> str:
        return " ".join(self.rng.choice(self.words) for _ in range(self.rng.randint(low, high)))

    def prose(self) -> str:
        r = self.rng.random()
        if r < 0.5:
            return self.rng.choice(self.texts)
        return self.some(1, 6) + "." if r < 0.65 else self.some(8, 90) + "."

    def names(self, kind: str) -> str:
        r = self.rng
        if r.random() < 0.12:
            return ""
        own = [r.choice(NAMES[kind])] + ([r.choice(NAMES["neutral"])] if r.random() < 0.2 else [])
        if r.random() < 0.15:
            own[0] += r.choice(["-1", "_box", "-wrapper", "Area", "-inner", "2"])
        return f' {r.choice(["class", "class", "id"])}="{" ".join(own)}"'

    def part(self, kind: str, inside: str) -> str:
        tag = self.rng.choice(TAGS[kind])
        names = self.names(kind)
        if tag in ("div", "section", "td", "p") and not names and kind != "main":
            names = f' class="{self.rng.choice(NAMES[kind])}"'
        return f"<{tag}{names}>{inside}</{tag}>"

    def leaf(self, text: str, tag: str | None = None) -> str:
        tag = tag or self.rng.choice(["p", "p", "p", "div", "span"])
        return f"<{tag}>{escape(text, quote=False)}</{tag}>"

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{k}">{escape(self.some(1, 5), quote=False)}</a>' for k in range(self.rng.randint(low, high))]
        if self.rng.random() < 0.65:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.rng.choice([" | ", " ", " &middot; "]).join(items)

    def other(self, kind: str) -> str:
        r = self.rng
        if kind in ("menu", "share"):
            inside = self.links(2, 9)
        elif kind == "header":
            inside = self.leaf(self.some(1, 4), r.choice(["h1", "div", "p", "a", "h2"])) + (self.leaf(self.some(2, 9)) if r.random() < 0.5 else "") + (self.other("menu") if r.random() < 0.4 else "")
        elif kind == "footer":
            inside = r.choice(["&copy; ", "", "Copyright ", "&copy; 2024 "]) + escape(self.some(1, 12), quote=False) + (self.links(2, 5) if r.random() < 0.5 else "") + (self.leaf(self.prose()) if r.random() < 0.2 else "")
        elif kind == "side":
            inside = self.leaf(self.some(1, 3), r.choice(["h2", "h3", "h4", "p"])) + (self.links(2, 6) if r.random() < 0.6 else "") + (self.leaf(self.prose()) if r.random() < 0.6 else "")
        elif kind == "form":
            inside = f"<label>{escape(self.some(1, 4), quote=False)}</label><input name=q><button>{escape(self.some(1, 2), quote=False)}</button>" + (self.leaf(self.some(3, 12)) if r.random() < 0.5 else "")
            if r.random() < 0.3:
                inside += "<select>" + "".join(f"<option>{escape(self.some(1, 2), quote=False)}</option>" for _ in range(3)) + "</select>"
            return f"<form{self.names('form')}>{inside}</form>"
        elif kind == "comments":
            inside = self.leaf(self.some(1, 3), r.choice(["h2", "h3", "p"])) if r.random() < 0.7 else ""
            said = []
            for _ in range(r.randint(1, 5)):
                who = self.leaf(self.some(1, 2), r.choice(["b", "span", "cite", "h4"])) if r.random() < 0.7 else ""
                said.append(who + "".join(self.leaf(self.prose(), r.choice(["p", "p", "div"])) for _ in range(r.randint(1, 2))))
            shape = r.choice(["li", "div", "article", "plain"])
            inside += {"li": lambda: "<ol>" + "".join(f"<li>{x}</li>" for x in said) + "</ol>", "div": lambda: "".join(f'<div class="{r.choice(["comment", "reply", "comment-body", "item"])}">{x}</div>' for x in said), "article": lambda: "".join(f"<article class=comment>{x}</article>" for x in said), "plain": lambda: "".join(said)}[shape]()
            inside += self.other("form") if r.random() < 0.4 else ""
        else:  # notice, advert
            inside = r.choice([lambda: escape(self.some(2, 25), quote=False), lambda: self.leaf(self.some(2, 30)), lambda: self.leaf(self.some(1, 4), "h4") + self.leaf(self.prose()), lambda: self.leaf(self.some(3, 12)) + f"<button>{escape(self.some(1, 2), quote=False)}</button>"])()
        return self.part(kind, inside)

    MARK = ""

    def article(self) -> str:
        """Main text; its blocks begin with a mark."""
        r, out = self.rng, []

        def leaf(text: str, tag: str | None = None) -> str:
            body = escape(text, quote=False)
            if r.random() < 0.15:
                body = f"<{(t := r.choice(['b', 'i', 'em', 'strong', 'span']))}>{body}</{t}>"
            if r.random() < 0.1:
                body += f' <a href="/x">{escape(self.some(1, 4), quote=False)}</a>'
            return f"<{tag or 'p'}>{self.MARK}{body}</{tag or 'p'}>"

        head = leaf(self.some(2, 12), r.choice(["h1", "h1", "h2"])) if r.random() < 0.85 else ""
        if head and r.random() < 0.25:
            head = f"<header>{head}</header>"
        own_tag = r.choice(["p", "p", "p", "p", "div"])
        for _ in range(r.choice([1, 2, 4, 7, 11, 16])):
            x = r.random()
            if x < 0.78:
                out.append(leaf(self.prose(), own_tag))
            elif x < 0.86:
                out.append(leaf(self.some(1, 7), r.choice(["h2", "h3"])))
            elif x < 0.92:
                out.append("<ul>" + "".join(leaf(self.some(2, 20), "li") for _ in range(r.randint(1, 5))) + "</ul>")
            elif x < 0.95:
                out.append(f"<blockquote>{leaf(self.prose())}</blockquote>")
            elif x < 0.97:
                out.append("<table><tr>" + "".join(leaf(self.some(1, 5), "td") for _ in range(3)) + "</tr></table>")
            elif x < 0.985:
                out.append(f"<figure><img src=x>{leaf(self.some(2, 12), 'figcaption')}</figure>")
            else:
                out.append(leaf(self.some(3, 20), "pre"))
            if r.random() < 0.05:
                out.append(self.other(r.choice(["advert", "advert", "share", "side", "notice", "form"])))
        inside = "".join(out)
        if r.random() < 0.3:
            inside = f"<div{self.names(r.choice(['main', 'neutral']))}>{inside}</div>"
        inside = head + inside
        if r.random() < 0.15:
            inside += self.other(r.choice(["share", "comments", "side", "menu"]))
        if r.random() < 0.12 and head:
            return head + self.part("main", inside[len(head) :])
        return self.part("main", inside)

    def page(self) -> str:
        r = self.rng
        before = [k for k, p in (("notice", 0.3), ("header", 0.6), ("menu", 0.7), ("form", 0.25), ("advert", 0.45), ("menu", 0.2), ("side", 0.2)) if r.random() < p]
        after = [k for k, p in (("share", 0.2), ("comments", 0.5), ("side", 0.45), ("advert", 0.35), ("form", 0.2), ("menu", 0.15), ("footer", 0.8), ("notice", 0.2)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(before)
            r.shuffle(after)
        body = [*map(self.other, before), self.article(), *map(self.other, after)]
        if r.random() < 0.4:
            lo, hi = r.randint(0, len(before)), r.randint(len(before) + 1, len(body))
            body[lo:hi] = [f"<div{self.names(r.choice(['neutral', 'neutral', 'main']))}>{''.join(body[lo:hi])}</div>"]
        inside = "".join(body)
        for _ in range(r.choice([0, 0, 1, 2])):
            inside = f"<div{self.names('neutral')}>{inside}</div>"
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{inside}</body></html>"
