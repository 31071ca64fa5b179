"""Labelled pages to learn main text from: the texts of given pages in page layouts of many kinds.

A page whose main text its own markup names (article, main) says which of its blocks are main text and which are not. Each layout puts the main
blocks under other elements and class names, or none, and around and between them menus, headers, footers, sidebars, notices, adverts, forms and
reader comments with texts of the page. Main text carries MARK, which is taken out before features are counted. The draws come from the page
itself, so a page gives the same layouts in every run.
"""

from __future__ import annotations

import html
import random

from tremor.llm.dom import AGAINST, MAIN_BIT, Pages

MARK = "\ue000"

# fixed values: names of containers, and words of chrome
MAIN_NAMES = "article post entry content post-content entry-content article-body articleBody story-body main-content post_body blog-post text news-item".split()
PLAIN_NAMES = "wrapper container row col-md-8 inner page layout grid box block section clearfix left center x1 c2".split()
CHROME = {
    "menu": "nav menu main-menu navbar nav-links breadcrumb breadcrumbs pagination site-navigation pager".split(),
    "frame": "header site-header masthead banner footer site-footer page-footer copyright legal".split(),
    "side": "sidebar widget right-rail related related-posts recommended popular-posts side-bar trending widget-area share-buttons social".split(),
    "notice": "cookie-notice cookies consent-banner notice alert gdpr popup newsletter subscribe-box".split(),
    "advert": "ad ads advert advertisement sponsored promo ad-slot adsbygoogle promo-box".split(),
    "comment": "comments comment-list commentlist disqus_thread comment reader-comments responses replies discussion".split(),
    "form": "login-form search-form contact-form signup form register".split(),
}
WORDS = (
    "Home About Contact News Sports Search Login Register More Share Menu Privacy Terms Next Previous Archive Help Shop Blog Subscribe Follow Reply Read Cookies Accept "
    "Weather Politics World Culture Tags Categories Popular Related Advertisement Sponsored Newsletter Comments Copyright Reserved Imprint Startseite Kontakt Impressum Accueil Inicio"
).split()


def taught_blocks(page: str | None) -> tuple[list[tuple[str, str]], list[str]]:
    """(tag, text) of the blocks that the page's markup makes main text, and the other texts. Without article and main: paragraphs of 80 characters outside chrome."""
    nodes = Pages()
    nodes.add((page or "").replace(MARK, ""))
    named = any(t in ("article", "main") for t in nodes.tag)
    main, rest = [], []
    for tag, text, bits, above in zip(nodes.tag, nodes.text, nodes.bits, nodes.above, strict=True):
        if text:
            good = (bits | above) & MAIN_BIT if named else tag == "p" and len(text) >= 80
            if good and not (bits | above) & AGAINST:
                main.append((tag, text))
            else:
                rest.append(text)
    return main, rest


class Layout:
    """One labelled page, drawn by rng."""

    def __init__(self, rng: random.Random, main: list[tuple[str, str]], rest: list[str]) -> None:
        self.rng, self.main = rng, main
        self.rest = [t for t in rest if len(t) < 400] or ["x"]
        self.long = [t for _, t in main if len(t) >= 40] or [t for _, t in main]

    def words(self, low: int, high: int) -> str:
        pool = self.rng.choice((WORDS, self.rng.choice(self.rest).split() or WORDS, self.rng.choice(self.long).split()))
        return html.escape(" ".join(self.rng.choice(pool) for _ in range(self.rng.randint(low, high))))

    def sentence(self) -> str:
        """A piece of running text, as long as main text may be."""
        text = self.rng.choice(self.long)
        cut = self.rng.choice((60, 150, 400, 1500))
        start = self.rng.randrange(max(1, len(text) - cut))
        return html.escape(text[start : start + cut])

    def attribute(self, names: list[str], p: float = 1.0) -> str:
        if self.rng.random() > p:
            return ""
        chosen = self.rng.sample(names, min(len(names), self.rng.choice((1, 1, 2))))
        return f' {self.rng.choice(("class", "class", "id"))}="{" ".join(chosen)}"'

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.rng.randrange(999)}">{self.words(low, high)}</a>'

    def links(self, low: int, high: int, words: tuple[int, int] = (1, 3)) -> str:
        found = [self.link(*words) for _ in range(self.rng.randint(low, high))]
        if self.rng.random() < 0.7:
            return f"<ul>{''.join(f'<li>{x}</li>' for x in found)}</ul>"
        return self.rng.choice((" | ", " ", " &middot; ")).join(found)

    def chrome(self, kind: str) -> str:
        """A block that is no main text."""
        rng = self.rng
        named = self.attribute(CHROME[kind], 0.85)
        if kind in ("menu", "side", "frame") and rng.random() < 0.12:  # only what it holds tells
            bare = self.attribute(PLAIN_NAMES, 0.5)
            return f"<div{bare}>{rng.choice((f'<h3>{self.words(1, 4)}</h3>', ''))}{self.links(3, 9, (1, 7))}</div>" if rng.random() < 0.7 else f"<div{bare}>&copy; {self.words(2, 12)}</div>"
        if kind == "menu":
            tag = rng.choice(("nav", "nav", "div", "ul", "section"))
            named = named or self.attribute(CHROME[kind], 0.0 if tag == "nav" else 0.7)
            body = self.links(2, 12)
            return f"<ul{named}>{''.join(f'<li>{self.link()}</li>' for _ in range(rng.randint(2, 9)))}</ul>" if tag == "ul" else f"<{tag}{named}>{body}</{tag}>"
        if kind == "frame":
            tag = rng.choice(("footer", "header", "div"))
            named = named if tag != "div" else named or self.attribute(CHROME[kind])
            if rng.random() < 0.3:
                return f"<{tag}{named}>{rng.choice(('&copy; ', ''))}{self.words(1, 9)} &middot; {rng.choice((self.sentence(), self.words(2, 20)))}</{tag}>"
            parts = [f"<p>{self.words(2, 20)}</p>", f"&copy; {self.words(1, 12)}", self.links(2, 8), f"<div>{self.words(1, 4)}</div>", f"<h1>{self.words(1, 3)}</h1>", f"<p>{self.sentence()}</p>"]
            return f"<{tag}{named}>{''.join(rng.sample(parts, rng.randint(1, 3)))}</{tag}>"
        if kind == "side":
            tag = rng.choice(("aside", "div", "section"))
            named = named if tag == "aside" else named or self.attribute(CHROME[kind])
            widget = lambda: rng.choice((f"<h3>{self.words(1, 4)}</h3>{self.links(3, 8, (2, 9))}", f"<h4>{self.words(1, 4)}</h4><p>{self.sentence()}</p>", f"<p>{self.words(3, 25)}</p>", f"<div>{self.link(2, 8)}<p>{self.words(5, 30)}</p></div>"))
            return f"<{tag}{named}>{''.join(f'<div>{widget()}</div>' if rng.random() < 0.5 else widget() for _ in range(rng.randint(1, 4)))}</{tag}>"
        if kind == "notice":
            named = named or rng.choice((' role="alert"', ' role="dialog"', ' class="notice"'))
            body = rng.choice((f"<p>{self.sentence()}</p>", self.sentence(), f"<p>{self.words(5, 30)}</p>", self.words(5, 25)))
            return f"<{(t := rng.choice(('div', 'section', 'aside')))}{named}>{body}{rng.choice(('', '<button>OK</button>', self.link()))}</{t}>"
        if kind == "advert":
            body = rng.choice((self.words(2, 15), f"<p>{self.sentence()}</p>", self.link(2, 8), f"<p>{self.words(3, 20)}</p>", f"<h4>{self.words(1, 4)}</h4><p>{self.words(3, 20)}</p>"))
            return f"<div{named or self.attribute(CHROME[kind])}>{body}</div>"
        if kind == "form":
            fields = "".join(rng.choice((f"<label>{self.words(1, 3)}</label><input name=q>", f"<p>{self.words(1, 9)}<input></p>", f"<select><option>{self.words(1, 2)}</select>", f"<textarea>{self.words(1, 5)}</textarea>", f"<div>{self.words(1, 6)}</div><input>")) for _ in range(rng.randint(1, 4)))
            heading = rng.choice(("", f"<h3>{self.words(1, 4)}</h3>", f"<p>{self.words(4, 20)}</p>"))
            return f"<form{named}>{heading}{fields}<button>{self.words(1, 2)}</button></form>"
        posts = []
        for _ in range(rng.randint(1, 6)):
            who = rng.choice((f"<b>{self.words(1, 2)}</b> ", f"<div>{self.link(1, 2)}</div>", f"<cite>{self.words(1, 2)}</cite>", f"<h4>{self.words(1, 2)}</h4>"))
            said = rng.choice((f"<p>{self.sentence()}</p>", f"<p>{self.words(2, 30)}</p>", f"<p>{self.sentence()}</p><p>{self.sentence()}</p>", self.sentence()))
            inner = self.attribute(["comment", "reply", "comment-body"], 0.6)
            posts.append(f"<{(t := rng.choice(('li', 'div', 'article' if inner else 'div')))}{inner}>{who}{said}</{t}>")
        body = "".join(posts)
        body = f"<ol>{body}</ol>" if "<li" in body else body
        return f"<{(t := rng.choice(('div', 'section')))}{named or self.attribute(CHROME[kind])}>{rng.choice(('', f'<h3>{self.words(1, 3)}</h3>', '<h2>Comments</h2>'))}{body}</{t}>"

    def heading(self) -> str:
        """A heading of main text, of one word to a line."""
        words = self.rng.choice(self.long).split()
        low = self.rng.randrange(len(words))
        return MARK + html.escape(" ".join(words[low : low + self.rng.choice((1, 2, 3, 5, 10))]))

    def block(self, tag: str, text: str) -> str:
        """A block of main text; its words carry the mark. What it says must not matter where it stands, so some are cut or set otherwise."""
        rng = self.rng
        if rng.random() < 0.3:
            words = text.split()
            words = words[: rng.choice((1, 1, 2, 3, 5, 12, 40))]
            text = rng.choice((" ", " ", " ", " | ", ", ", ". ", " - ")).join(words)
        if rng.random() < 0.05:
            text = text.upper()
        said = MARK + html.escape(text)
        if rng.random() < 0.3 and len(text) > 20:
            at = rng.randrange(len(said))
            while at and said[at] != " ":
                at -= 1
            if at:
                inline = rng.choice(("b", "em", "a", "span", "strong", "code"))
                end = said.find(" ", at + 1 + rng.randrange(60))
                end = len(said) if end < 0 else end
                said = f"{said[:at]} <{inline}{' href=/x' if inline == 'a' else ''}>{said[at + 1 : end]}</{inline}>{said[end:]}"
        if tag in ("h1", "h2", "h3") or rng.random() < 0.08:
            level = tag if tag[0] == "h" else rng.choice(("h2", "h2", "h3", "h4"))
            return f"<{level}>{rng.choice((said, self.heading()))}</{level}>"
        kind = rng.random()
        if kind < 0.72:
            return f"<p>{said}" + rng.choice(("</p>", "</p>", "</p>\n", ""))
        if kind < 0.80:
            return f"<div>{said}</div>"
        if kind < 0.86:
            half = len(said) // 2
            return f"<ul><li>{said[:half]}</li><li>{MARK}{said[half:]}</li></ul>" if "<" not in said and "&" not in said else f"<ol><li>{said}</ol>"
        if kind < 0.90:
            return f"<blockquote>{rng.choice(('', '<p>'))}{said}</blockquote>"
        if kind < 0.93:
            return f"<figure><img src=x><figcaption>{said}</figcaption></figure>"
        if kind < 0.96:
            return f"<table><tr><td>{said}</td><td>{MARK}{html.escape(text[:12])}</td></tr></table>"
        if kind < 0.98:
            return f"<pre>{said}</pre>"
        return f"{said}<br>"

    def page(self) -> str:
        rng = self.rng
        chosen = self.main
        if len(chosen) > 1 and rng.random() < 0.6:
            low = rng.randrange(len(chosen))
            chosen = chosen[low : low + rng.choice((1, 2, 4, 9, 30))]
        body = [self.block(tag, text) for tag, text in chosen]
        if rng.random() < 0.7:
            title = f"<{(t := rng.choice(('h1', 'h1', 'h2')))}>{self.heading()}</{t}>"
            body.insert(0, rng.choice((title, title, f"<header{self.attribute(['entry-header', 'post-header'], 0.5)}>{title}</header>", f'<div class="post-header">{title}</div>')))
        if len(body) > 4 and rng.random() < 0.25:
            cut = rng.randrange(1, len(body))
            body[cut:] = [f"<{(t := rng.choice(('section', 'div')))}{self.attribute(PLAIN_NAMES, 0.4)}><h2>{self.heading()}</h2>", *body[cut:], f"</{t}>"]
        for kind in ("advert", "side", "form", "notice", "menu"):
            if rng.random() < 0.16:
                body.insert(rng.randrange(1, len(body) + 1), self.chrome(kind))
        after = []
        for kind, p in (("side", 0.2), ("comment", 0.4), ("form", 0.1), ("menu", 0.1)):
            if rng.random() < p:
                (body if rng.random() < 0.3 else after).append(self.chrome(kind))
        tag = rng.choice(("article", "article", "main", "div", "div", "section", "td", "none"))
        named = self.attribute(MAIN_NAMES, 0.5 if tag in ("div", "section", "td") else 0.4) or self.attribute(PLAIN_NAMES, 0.3)
        inner = "\n".join(body) if rng.random() < 0.5 else "".join(body)
        if tag == "td":
            core = f"<td{named}>{inner}</td>"
        elif tag == "none":
            core = inner
        else:
            core = f"<{tag}{named}>{inner}</{tag}>"
            if tag == "article" and rng.random() < 0.4:
                core = f"<main>{core}</main>"
            elif rng.random() < 0.3:
                core = f"<div{self.attribute(PLAIN_NAMES + MAIN_NAMES[:4], 0.8)}>{core}</div>"
        core += "".join(after)
        side = [self.chrome(rng.choice(("side", "side", "advert"))) for _ in range(rng.choice((0, 0, 1, 2)))]
        if tag == "td":
            cells = [core, *(f"<td>{x}</td>" for x in side)]
            rng.shuffle(cells)
            middle = f"<table><tr>{''.join(cells)}</tr></table>"
        else:
            side = [f"<div{self.attribute(PLAIN_NAMES, 0.6)}>{x}</div>" if rng.random() < 0.2 else x for x in side]
            left = rng.randint(0, len(side))
            middle = "".join([*side[:left], core, *side[left:]])
        if rng.random() < 0.4:
            middle = f"<div{self.attribute(PLAIN_NAMES, 0.8)}>{middle}</div>"
        if rng.random() < 0.08:
            middle = f"<form action=/x>{middle}</form>"  # some sites put the whole page into one
        top = [self.chrome(k) for k in ("frame", "menu", "notice", "advert", "form") if rng.random() < (0.7 if k == "menu" else 0.3)]
        bottom = [self.chrome(k) for k in ("menu", "notice", "frame") if rng.random() < (0.75 if k == "frame" else 0.2)]
        rng.shuffle(top)
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title><script>var a='<p>';</script></head><body>{''.join(top)}{middle}{''.join(bottom)}</body></html>"


def labelled_nodes(page: str | None, variants: int) -> tuple[list[list[float]], list[float]]:
    """Features and labels of the nodes of a page's layouts, and of the page as it is: 1 where a node holds main text, else 0."""
    main, rest = taught_blocks(page)
    rows: list[list[float]] = []
    labels: list[float] = []
    if not main:
        return rows, labels
    rng = random.Random(page)
    for k in range(variants + 1):
        nodes = Pages()
        if k < variants:
            nodes.add(Layout(rng, main, rest).page())
            holds = [MARK in t for t in nodes.text]
            nodes.text = [t.replace(MARK, "") for t in nodes.text]
        else:
            nodes.add((page or "").replace(MARK, ""))
            known = set(main)
            holds = [bool(t) and (tag, t) in known for tag, t in zip(nodes.tag, nodes.text, strict=True)]
        for i in range(len(holds) - 1, 0, -1):
            if holds[i] and nodes.parent[i] >= 0:
                holds[nodes.parent[i]] = True
        keep = [i for i in range(1, len(holds)) if nodes.children[i] or nodes.text[i]]
        rows += nodes.features()[keep].tolist()
        labels += [float(holds[i]) for i in keep]
    return rows, labels
