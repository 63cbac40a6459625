"""Labelled web pages: invented pages in which every word of the article carries a mark.

The layouts follow habits of public web pages: sectioning elements, classed boxes, bare boxes and layout tables, with menus, banners, notices, adverts,
forms, sidebars and reader comments around and inside the article. Words are drawn from syllables, so nothing but markup,
lengths and punctuation can be learned. The same seed gives the same pages.
"""

from __future__ import annotations

import random

#: Put before each word of the article; in no page of the web, since HTML forbids it.
MARK = "\x01"
#: Pages that the weights are fitted on: the bound of the labelled sample.
PAGES = 800

# Class words that public pages give to what isn't the article, by kind.
CLASSES = {
    "menu": "nav navbar menu main-menu navigation breadcrumb breadcrumbs toolbar pagination pager tabs site-nav menubar".split(),
    "header": "header masthead banner site-header top-bar page-header logo branding topbar".split(),
    "footer": "footer site-footer copyright legal bottom-bar contentinfo footer-links page-footer".split(),
    "side": "sidebar aside widget related related-posts promo promoted most-read trending recommended complementary side-column".split(),
    "notice": "cookie cookie-banner consent notice gdpr alert modal popup disclaimer cookies cookie-notice".split(),
    "advert": "ad ads advert advertisement sponsored sponsor ad-slot banner-ad advertising google-ads adverts".split(),
    "form": "search newsletter subscribe login signup search-form contact-form".split(),
    "share": "share social share-buttons social-links meta tags post-meta sharing byline".split(),
    "comment": "comments comment replies respond disqus comment-list reader-comments discussion comment-body".split(),
}
# Class words of articles, and of article paragraphs that only look like something else.
BODIES = "post entry entry-content article-body story content post-content main-text text story-body article body-copy page-content".split()
LOOKALIKES = "share-price related-work header-note comment-worthy ad-hoc menu-of-the-day social-history banner-year footer-ball search-party notice-period tag-team side-effects form-of-address".split()
PLAIN = "row col container wrapper inner box block section x1 x2 module grid-12 clearfix lead intro s1 outer unit panel".split()


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def maybe(self, p: float) -> bool:
        return self.r.random() < p

    def word(self) -> str:
        return "".join(self.r.choice(("ba", "co", "de", "fi", "gu", "la", "me", "no", "pi", "ru", "sta", "ten", "ver", "zo")) for _ in range(self.r.randint(1, 4)))

    def words(self, lo: int, hi: int, mark: str = "") -> list[str]:
        out = [self.word() for _ in range(self.r.randint(lo, hi))]
        out[0] = out[0].capitalize()
        return [mark + w for w in out]

    def prose(self, lo: int, hi: int, mark: str = "", links: float = 0.1) -> str:
        """Sentences with a few inline elements."""
        out: list[str] = []
        for _ in range(self.r.randint(lo, hi)):
            s = self.words(3, 18, mark)
            if self.maybe(links):
                i = self.r.randrange(len(s))
                s[i] = f'<a href="/{self.word()}">{s[i]}</a>'
            if self.maybe(0.15):
                i = self.r.randrange(len(s))
                tag = self.r.choice(("b", "em", "i", "strong", "span", "code"))
                s[i] = f"<{tag}>{s[i]}</{tag}>"
            out.append(" ".join(s) + self.r.choice("." * 5 + "?!:"))
            if self.maybe(0.04):
                out.append("<br>")
        text = " ".join(out)
        return text[:-1] if self.maybe(0.2) and text[-1] != ">" else text

    def named(self, kind: str) -> str:
        own = [self.r.choice(CLASSES[kind])]
        if self.maybe(0.3):
            own.append(self.r.choice(PLAIN))
        return f' {self.r.choice(("class", "class", "class", "id"))}="{" ".join(own)}"'

    def plain(self) -> str:
        return f' class="{self.r.choice(PLAIN)}"' if self.maybe(0.4) else ""

    def box(self, kind: str, element: str, inner: str, marked: bool) -> str:
        """``inner`` in its sectioning element, a classed box or (not ``marked``) a bare one."""
        if not marked:
            return f"<div{self.plain()}>{inner}</div>"
        if element and self.maybe(0.5):
            return f"<{element}{self.named(kind) if self.maybe(0.4) else ''}>{inner}</{element}>"
        return f"<div{self.named(kind)}>{inner}</div>"

    def links(self, lo: int, hi: int) -> str:
        own = [f'<a href="/{self.word()}">{" ".join(self.words(1, 3))}</a>' for _ in range(self.r.randint(lo, hi))]
        form = self.r.randrange(3)
        if form == 0:
            return "<ul>" + "".join(f"<li>{a}</li>" for a in own) + "</ul>"
        return " | ".join(own) if form == 1 else "".join(f"<div>{a}</div>" for a in own)

    def form(self) -> str:
        return f'<form{self.named("form") if self.maybe(0.5) else ""}><label>{" ".join(self.words(1, 4))}</label><input><select><option>{self.word()}</option></select><button>{self.word()}</button></form>'

    def comments(self, marked: bool) -> str:
        one = lambda: f'<li class="comment"><b>{self.word()}</b><p>{self.prose(1, 4)}</p></li>' if marked else f"<p>{self.prose(1, 2)}</p>"
        return self.box("comment", "section", f"<h3>{' '.join(self.words(1, 2))}</h3><ol>{''.join(one() for _ in range(self.r.randint(1, 6)))}</ol>", True)

    def boilerplate(self, marked: bool, before: bool) -> str:
        out = []
        short = lambda: self.prose(1, 1, links=0.5)
        if before:
            if self.maybe(0.5):
                out.append(self.box("header", "header", f"<div>{' '.join(self.words(1, 3))}</div>" + (self.links(2, 5) if self.maybe(0.5) else ""), marked))
            if self.maybe(0.8):
                out.append(self.box("menu", "nav", self.links(2, 9), marked))
        if self.maybe(0.4):
            out.append(self.box("notice", "dialog" if self.maybe(0.2) else "", f"{short()} <a href='/{self.word()}'>{self.word()}</a>", True))
        if self.maybe(0.5):
            out.append(self.box("advert", "", self.prose(1, 3) if self.maybe(0.3) else short(), True))
        if self.maybe(0.3):
            out.append(self.form())
        if self.maybe(0.4):
            inner = f"<h3>{' '.join(self.words(1, 3))}</h3>" + (self.links(2, 6) if self.maybe(0.7) else f"<p>{self.prose(1, 3)}</p>")
            out.append(self.box("side", "aside", inner, marked))
        if self.maybe(0.1):
            out.append(f"<div{self.r.choice((' hidden', ' aria-hidden=true'))}>{self.prose(1, 3)}</div>")
        if not before:
            if self.maybe(0.35):
                out.append(self.comments(marked))
            if self.maybe(0.9):
                inner = f"&copy; {self.word()} &middot; {short()}" if self.maybe(0.5) else f"<p>{' '.join(self.words(2, 6))}</p>" + self.links(1, 5)
                out.append(self.box("footer", "footer", inner, marked))
        if before:
            return "".join(out)
        self.r.shuffle(out)
        return "".join(out)

    def inset(self) -> str:
        """What isn't the article, inside it."""
        k = self.r.randrange(5)
        if k == 0:
            return self.box("share", "", self.links(2, 4) if self.maybe(0.6) else " ".join(self.words(2, 6)), True)
        if k == 1:
            return self.box("advert", "aside", self.prose(1, 2), True)
        if k == 2:
            return self.box("side", "aside", f"<h4>{' '.join(self.words(1, 3))}</h4>{self.links(2, 4)}", True)
        return self.form() if k == 3 else self.box("notice", "", self.prose(1, 1), True)

    def article(self, insets: bool) -> str:
        m = MARK
        own = [f"<h1>{' '.join(self.words(2, 12, m))}</h1>"] if self.maybe(0.9) else []
        if own and self.maybe(0.2):
            own = [f"<header>{own[0]}</header>"]
        for _ in range(self.r.choice((1, 1, 2, 3, 4, 6, 9))):
            k = self.r.random()
            if k < 0.62:
                attr = f' class="{self.r.choice(LOOKALIKES)}"' if self.maybe(0.12) else self.plain() if self.maybe(0.1) else ""
                own.append(f"<p{attr}>{self.prose(1, 6, m)}" + ("</p>" if self.maybe(0.9) else ""))
            elif k < 0.72:
                own.append(f"<h2>{' '.join(self.words(1, 6, m))}</h2><p>{self.prose(1, 4, m)}</p>")
            elif k < 0.84:
                item = lambda: " ".join(self.words(1, 7, m)) if self.maybe(0.6) else self.prose(1, 2, m)
                tag = self.r.choice(("ul", "ol"))
                own.append(f"<{tag}>" + "".join(f"<li>{item()}</li>" for _ in range(self.r.randint(2, 6))) + f"</{tag}><p>{self.prose(1, 4, m)}</p>")
            elif k < 0.91:
                cells = lambda t: "".join(f"<{t}>{' '.join(self.words(1, 2, m))}</{t}>" for _ in range(3))
                own.append("<table><tr>" + cells("th") + "</tr>" + "".join(f"<tr>{cells('td')}</tr>" for _ in range(self.r.randint(1, 4))) + f"</table><p>{self.prose(1, 4, m)}</p>")
            elif k < 0.95:
                own.append(f"<blockquote>{self.prose(1, 3, m)}</blockquote>")
            elif k < 0.98:
                own.append(f"<figure><img src=x><figcaption>{self.prose(1, 1, m)}</figcaption></figure><p>{self.prose(1, 4, m)}</p>")
            else:
                own.append(f"<div{self.plain()}>{self.prose(1, 5, m)}</div>")
            if insets and self.maybe(0.2):
                own.append(self.inset())
        return "".join(own)

    def page(self, element: bool | None) -> str:
        kind = self.r.randrange(4)  # sectioning elements, classed boxes, bare boxes, layout table
        if element is not None:
            kind = 0 if element else 1 + self.r.randrange(3)
        marked = kind < 2 or self.maybe(0.3)
        body = self.article(insets=self.maybe(0.5))
        if kind == 0:
            name = self.r.choice(("article", "article", "main"))
            extra = self.comments(True) if self.maybe(0.15) else ""
            body = f"<{name}{self.plain()}>{body}{extra}</{name}>"
            if self.maybe(0.3):
                body = f"<main>{body}</main>" if name == "article" else f"<section>{body}</section>"
        elif kind == 1:
            body = f'<div class="{self.r.choice(BODIES)}">{body}</div>'
        elif self.maybe(0.7):
            body = f"<div{self.plain()}>{body}</div>"
        before, after = self.boilerplate(marked, True), self.boilerplate(marked, False)
        if kind == 3:
            rest = f"<table><tr><td>{before}</td><td>{body}</td></tr></table>{after}"
        else:
            rest = before + body + after
            if self.maybe(0.4):
                rest = f"<div{self.plain()}>{rest}</div>"
        title = " ".join(self.words(2, 8))
        return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style></head><body>{rest}</body></html>'


def labelled_pages(n: int = PAGES, seed: int = 0, *, element: bool | None = None) -> list[str]:
    """``n`` pages with marked words; with (True), without (False) or with or without (None) an ``article`` or ``main`` element."""
    return [_Page(seed * 1_000_003 + i).page(element) for i in range(n)]
