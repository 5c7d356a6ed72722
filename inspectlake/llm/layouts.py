"""Training pages for main-text extraction: the words of a real page in a drawn layout.

Parts are marked with ``data-part``: ``main`` for the article, ``other`` for all that is
around it or put into it.  Names, tags, order and nesting are drawn, so that a model has to
weigh names, texts and surroundings against each other.
"""

import html
import random

#: Names that parts of pages commonly go by.
NAMES = {
    "article": "article post entry content story main article-body post-content entry-content story-text page-content body-copy".split(),
    "nav": "nav menu navbar navigation topnav main-menu breadcrumb breadcrumbs toc links pager tabs".split(),
    "header": "header masthead site-header banner topbar branding logo".split(),
    "footer": "footer site-footer colophon bottom copyright legal foot".split(),
    "aside": "sidebar side aside rail widget related recommended trending popular more-stories teaser read-next author-box tag-cloud".split(),
    "notice": "notice cookie cookie-consent consent alert gdpr popup modal overlay message warning paywall disclaimer announcement".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsense ad-slot banner-ad partner commercial".split(),
    "form": "form search newsletter signup subscribe login contact-form search-box register poll".split(),
    "comments": "comments comment-list commentlist discussion responses replies disqus reader-comments thread comment-section feedback".split(),
    "share": "share social tools sharing follow buttons actions print".split(),
}
LAYOUT = "wrap wrapper container row col grid outer inner layout site page column box block left right section block-inner clearfix".split()
TAGS = {
    "nav": ["nav"], "header": ["header"], "footer": ["footer"], "aside": ["aside"], "notice": ["div", "aside", "section", "dialog"], "advert": ["div", "aside", "section", "p"],
    "form": ["form"], "comments": ["section", "div"], "share": ["div", "ul"], "article": ["article", "main"],
}


class Layout:
    """One drawn page: ``words`` are those of a real page, in order."""

    def __init__(self, rng, words):
        self.rng, self.words = rng, words or ["word"]
        self.named = rng.random() < 0.8
        self.landmarks = rng.random() < 0.5

    def chance(self, p):
        return self.rng.random() < p

    def text(self, low, high):
        n, at = self.rng.randint(low, high), self.rng.randrange(len(self.words))
        return html.escape(" ".join(self.words[(at + k) % len(self.words)] for k in range(n)), quote=False)

    def link(self, low=1, high=4):
        return f'<a href="/{self.rng.randrange(999)}">{self.text(low, high)}</a>'

    def names(self, kind):
        if not self.named or self.chance(0.15):
            return ""
        rng, name = self.rng, self.rng.choice(NAMES[kind]) if kind else rng_name(self.rng)
        if self.chance(0.25):
            name = rng.choice([f"{rng.choice(LAYOUT)} {name}", f"{name}-{rng.choice(['1', 'a', 'main', 'top', 'inner', 'list', 'item'])}", f"c{rng.randrange(99)} {name}", f"{name} {name}_{rng.choice(LAYOUT)}"])
        return f' {rng.choice(["class", "class", "class", "id"])}="{name}"'

    def box(self, kind, inner, part=None, tag=None):
        tag = tag or (self.rng.choice(TAGS[kind]) if kind in TAGS and self.landmarks else "div")
        mark = f' data-part="{part}"' if part else ""
        return f"<{tag}{self.names(kind)}{mark}>{inner}</{tag}>"

    def wrapped(self, inner):
        for _ in range(self.rng.choice([0, 0, 1, 1, 2])):
            name = f' class="{self.rng.choice(LAYOUT)}"' if self.named else ""
            inner = f"<div{name}>{inner}</div>"
        return inner

    def paragraph(self, low=3, high=110):
        text = self.text(low, high)
        if self.chance(0.15):
            text = f"{self.text(1, 20)} {self.link()} {text}"
        if self.chance(0.1):
            return f"<p><b>{text}<br>"
        return f"<p>{text}</p>" if self.chance(0.9) else f"<div>{text}</div>"

    def menu(self):
        items = [self.link() for _ in range(self.rng.randint(2, 9))]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if self.chance(0.7) else " | ".join(items)

    def nav(self):
        return self.box("nav", self.menu(), "other", "ul" if self.chance(0.1) else None)

    def form(self):
        label, button = self.rng.choice([f"<label>{self.text(1, 5)}</label>", self.text(1, 4), ""]), f"<button>{self.text(1, 2)}</button>" if self.chance(0.7) else "<input type=submit>"
        more = self.rng.choice([f"<p>{self.text(3, 25)}</p>", f"<h3>{self.text(1, 4)}</h3>", f"<label>{self.text(1, 3)}</label><input>", "", ""])
        return self.box("form", f"{label}<input name=q>{more}{button}", "other", "form" if self.chance(0.6) else None)

    def hidden(self):
        how = self.rng.choice(['style="display:none"', "hidden", 'aria-hidden="true"', 'style="visibility: hidden"'])
        return f'<div {how} data-part="other">{self.rng.choice([self.text(2, 40), f"<p>{self.text(2, 40)}</p>", self.menu()])}</div>'

    def advert(self):
        inner = self.rng.choice([self.text(3, 40), f"<p>{self.text(3, 40)}</p>", f"<h4>{self.text(2, 6)}</h4><p>{self.text(4, 30)}</p>{self.link()}", f"<img src=a>{self.link(2, 8)}"])
        return self.box("advert", inner, "other")

    def notice(self):
        button = f"<button>{self.text(1, 2)}</button>" if self.chance(0.6) else self.link(1, 2)
        return self.box("notice", f"<p>{self.text(5, 45)}</p>{button}" if self.chance(0.7) else self.text(5, 45), "other")

    def share(self):
        return self.box("share", "".join(f"<li>{self.link(1, 2)}</li>" for _ in range(self.rng.randint(2, 5))), "other")

    def aside(self):
        inner = f"<h3>{self.text(1, 4)}</h3>"
        for _ in range(self.rng.randint(1, 5)):
            inner += self.rng.choice([f"<p>{self.text(4, 40)}</p>", f"<div>{self.link(3, 9)}</div>", f"<h4>{self.link(3, 9)}</h4><p>{self.text(5, 30)}</p>"])
        return self.box("aside", inner, "other")

    def comments(self):
        rng, inner = self.rng, f"<h3>{self.text(1, 4)}</h3>"
        tag, entry = rng.choice([("div", "div"), ("ul", "li"), ("ol", "li"), ("div", "article")])
        entries = ""
        for _ in range(rng.randint(1, 8)):
            author = rng.choice([f"<b>{self.text(1, 2)}</b>", f"<span>{self.text(1, 2)}</span>", f"<h5>{self.text(1, 2)}</h5>", f"<div>{self.text(1, 2)}</div>"])
            name = f' class="{rng.choice(["comment", "reply", "response", "comment-body", "comment even"])}"' if self.named and self.chance(0.8) else ""
            if self.chance(0.2):
                entries += f"<{entry}{name}>{self.text(3, 70)}</{entry}>"
                continue
            entries += f"<{entry}{name}>{author}<p>{self.text(3, 70)}</p>{self.link(1, 1) if self.chance(0.4) else ''}</{entry}>"
        inner += f"<{tag}>{entries}</{tag}>" + (self.form() if self.chance(0.4) else "")
        return self.box("comments", inner, "other")

    def article(self):
        rng, parts = self.rng, []
        title = f"<h1>{self.text(2, 14)}</h1>"
        parts.append(f"<header>{title}</header>" if self.chance(0.1) else title)
        if self.chance(0.15):
            parts.append(f"<p>{self.text(2, 6)}</p>")
        for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 9, 14, 25])):
            kind = rng.random()
            if kind < 0.75:
                parts.append(self.paragraph(*rng.choice([(3, 110), (1, 12), (30, 200)])))
            elif kind < 0.81:
                parts.append(f"<h{rng.randint(2, 4)}>{self.text(1, 8)}</h2>" if self.chance(0.05) else f"<h2>{self.text(1, 8)}</h2>")
            elif kind < 0.87:
                parts.append("<ul>" + "".join(f"<li>{self.text(1, 25)}" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote>{self.text(4, 50)}</blockquote>")
            elif kind < 0.93:
                parts.append("<table>" + "".join(f"<tr><th>{self.text(1, 3)}</th><td>{self.text(1, 6)}</td></tr>" for _ in range(rng.randint(2, 5))) + "</table>")
            elif kind < 0.95:
                parts.append(f"<figure><img src=a><figcaption>{self.text(3, 15)}</figcaption></figure>")
            elif kind < 0.97:
                parts.append(f"<pre><code>{self.text(5, 40)}</code></pre>")
            else:
                parts.append(f"<section><h2>{self.text(1, 6)}</h2>{self.paragraph()}{self.paragraph()}</section>")
        for other, p in ((self.advert, 0.3), (self.share, 0.2), (self.aside, 0.15), (self.form, 0.2), (self.notice, 0.12), (self.comments, 0.12), (self.hidden, 0.08), (self.nav, 0.05)):
            if self.chance(p):
                parts.insert(rng.randint(1, len(parts)), other())
        if self.chance(0.12):
            parts.append(self.comments())
        inner = "".join(parts)
        if self.chance(0.2):
            inner = f"<div>{inner}</div>"
        return self.box("article", inner, "main", None if self.landmarks or self.chance(0.85) else "td")

    def page(self):
        rng = self.rng
        top, bottom, around = [], [], []
        for make, p, where in (
            (self.notice, 0.3, top), (self.nav, 0.75, top), (self.advert, 0.4, top), (self.form, 0.2, top), (self.nav, 0.2, top), (self.advert, 0.25, bottom),
            (self.comments, 0.4, bottom), (self.aside, 0.3, bottom), (self.nav, 0.15, bottom), (self.notice, 0.15, bottom), (self.aside, 0.35, around), (self.nav, 0.1, around), (self.advert, 0.15, around), (self.hidden, 0.1, top), (self.hidden, 0.05, bottom),
        ):
            if self.chance(p):
                where.append(make())
        if self.chance(0.5):
            top.append(self.box("header", rng.choice([self.text(1, 5), f"<h1>{self.text(1, 4)}</h1>{self.text(0, 6)}", f"<a href=/>{self.text(1, 3)}</a>{self.menu()}"]), "other"))
        rng.shuffle(top)
        rng.shuffle(bottom)
        middle = around + [self.article()]
        rng.shuffle(middle)
        foot = self.box("footer", rng.choice([f"&copy; {self.text(1, 15)}", f"<p>{self.text(2, 30)}</p>", self.menu(), f"<p>{self.link()} {self.link()}</p><p>&copy; {self.text(2, 12)}</p>"]), "other")
        inner = "".join(top) + self.wrapped(self.wrapped("".join(middle)) + "".join(bottom[: len(bottom) // 2])) + "".join(bottom[len(bottom) // 2 :])
        inner += foot if self.chance(0.85) else ""
        if self.chance(0.04):
            inner = f"<form>{inner}</form>"
        return f"<!DOCTYPE html><html><head><title>{self.text(1, 9)}</title></head><body>{self.wrapped(inner)}</body></html>"


def rng_name(rng):
    return rng.choice(LAYOUT)


def drawn_pages(seed, words, n):
    """``n`` marked pages with these words; the same seed gives the same pages."""
    rng = random.Random(seed)
    return [Layout(rng, words).page() for _ in range(n)]
