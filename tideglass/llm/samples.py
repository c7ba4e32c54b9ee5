"""Labelled pages to learn from: articles among menus, headers, footers, adverts, notices, forms, sidebars and comments.

Nobody labels pages of a crawl, so labelled ones are composed: sentences of real pages in layouts drawn at random, with
telling element names and attribute tokens, with opaque ones, or with none. Every run of article text begins with MARK.
"""

from __future__ import annotations

import random
from collections.abc import Callable

MARK = "\ue000"
NAMES = {
    "content": "content post-content article-body entry-content story main-content post single-post article text-body page-content entry",
    "nav": "nav menu main-menu navbar breadcrumbs pagination nav-links site-nav topmenu",
    "header": "header site-header masthead page-header top-bar branding",
    "footer": "footer site-footer page-footer bottom copyright",
    "side": "sidebar widget aside side-column secondary widget-area rail",
    "ad": "ad ads advert ad-slot sponsored promo banner-ad advertisement",
    "notice": "cookie-notice cookie-banner consent notice alert gdpr popup modal",
    "comment": "comments comment-list comment reply responses discussion comment-body",
    "related": "related related-posts recommended more-stories read-more also-like popular",
    "share": "share social share-bar social-links sharing",
    "form": "search-form newsletter subscribe signup-form contact-form login form",
}
TAGS = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "ad": "aside", "notice": "aside", "comment": "section", "related": "aside", "share": "ul", "form": "form"}


def compose(number: int, sentences: list[str], seed: int = 12) -> str:
    """Page `number`; the same for the same sentences and seed."""
    rng = random.Random(seed * 1_000_003 + number)
    say = lambda n=1: " ".join(rng.choice(sentences) for _ in range(n)).replace("&", "&amp;").replace("<", "&lt;")
    word = lambda n=1: " ".join((say().split() or ["x"])[0] for _ in range(n))
    opaque = rng.random() < 0.2
    plain = rng.random() < 0.3  # no semantic elements

    def attr(kind: str) -> str:
        r = rng.random()
        if r < 0.15:
            return ""
        name = rng.choice(NAMES[kind].split())
        if opaque or r < 0.25:
            name = "".join(rng.choices("abcdefghijkmnpqrstuvwxz", k=rng.randint(3, 6)))
        if rng.random() < 0.2:
            name += rng.choice([" clearfix", " col-8", " js-x", " mt-4", " row"])
        return f' {rng.choice(["class", "class", "class", "id"])}="{name}"'

    def box(kind: str, inner: str, tag: str | None = None) -> str:
        tag = tag or (TAGS.get(kind, "div") if not plain and rng.random() < 0.45 else rng.choice(["div", "div", "section"]))
        if rng.random() < 0.2:
            inner = f"<div>{inner}</div>"
        return f"<{tag}{attr(kind)}>{inner}</{tag}>\n"

    def link(n: int = 1) -> str:
        return f'<a href="/{rng.randint(1, 999)}">{word(n)}</a>'

    def links(low: int, high: int, n: int = 1) -> str:
        if rng.random() < 0.75:
            return "<ul>" + "".join(f"<li>{link(rng.randint(1, n))}</li>" for _ in range(rng.randint(low, high))) + "</ul>"
        return rng.choice([" | ", " ", " &middot; "]).join(link(rng.randint(1, n)) for _ in range(rng.randint(low, high)))

    def nav() -> str:
        return box("nav", links(3, 9, 2))

    def header() -> str:
        return box("header", rng.choice([f"<h1>{link(2)}</h1>", f"<div>{word(2)}</div>", f"<p>{say()}</p>", f"<h2>{word(3)}</h2><p>{say()}</p>", link(1)]) + (nav() if rng.random() < 0.5 else ""))

    def footer() -> str:
        return box("footer", rng.choice([f"&copy; {word(2)} &middot; {say()}", f"<p>&copy; 2024 {word(2)}</p>{links(2, 6)}", f"<p>{say(rng.randint(1, 3))}</p>", links(3, 9)]))

    def ad() -> str:
        return box("ad", rng.choice([say(rng.randint(1, 3)), f"<p>{say()}</p>", f"{say()} {link(2)}", f"<b>{word(2)}</b><p>{say(rng.randint(1, 2))}</p>"]), rng.choice([None, "div"]))

    def notice() -> str:
        return box("notice", f"<p>{say(rng.randint(1, 3))}</p>" + rng.choice(["", f"<button>{word()}</button>", link(1)]), rng.choice([None, "div"]))

    def side() -> str:
        parts = [rng.choice([f"<h3>{word(2)}</h3>{links(3, 8, 6)}", f"<h4>{word()}</h4><p>{say(rng.randint(1, 3))}</p>", ad(), form(), f"<div>{say()}</div>"]) for _ in range(rng.randint(1, 4))]
        return box("side", "".join(parts))

    def related() -> str:
        return box("related", f"<h3>{word(2)}</h3>" + rng.choice([links(2, 6, 8), "".join(f"<div><h4>{link(4)}</h4><p>{say()}</p></div>" for _ in range(rng.randint(2, 4)))]))

    def share() -> str:
        return box("share", "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 5))), None if not plain else "ul")

    def form() -> str:
        return box("form", rng.choice([f"<label>{word(2)}</label><input><button>{word()}</button>", f"<p>{say()}</p><input type=text><button>{word()}</button>", f"<input name=q>{word()}"]), rng.choice(["form", None]))

    def comments() -> str:
        one = lambda: f"<{t}{attr('comment')}>" + rng.choice([f"<b>{word()}</b> {rng.randint(1, 28)}.{rng.randint(1, 12)}.2024", f"<div>{word(2)}</div>", f"<cite>{word()}</cite>", ""]) + rng.choice([f"<p>{say(rng.randint(1, 6))}</p>", f"<div>{say(rng.randint(1, 4))}</div>", f"<p>{say(2)}</p><p>{say(3)}</p>"]) + (link() if rng.random() < 0.4 else "") + f"</{t}>"
        t = rng.choice(["div", "li", "article" if not plain else "div", "div"])
        body = "".join(one() for _ in range(rng.randint(1, 8)))
        return box("comment", (f"<h3>{word(2)}</h3>" if rng.random() < 0.7 else "") + (f"<ol>{body}</ol>" if t == "li" else body) + (form() if rng.random() < 0.3 else ""))

    def main() -> str:
        m = lambda n=1: MARK + say(n)
        size = rng.choice([1, 1, 2, 3, 5, 8, 12, 20, 35])
        short = rng.random() < 0.15
        blocks: list[str] = []

        def inline(n: int) -> str:
            text = say(n)
            if rng.random() < 0.2:
                words = text.split(" ")
                k = rng.randrange(len(words))
                tag = rng.choice(["a href='/x'", "b", "i", "em", "strong", "span", "code"])
                words[k] = f"<{tag}>{MARK}{words[k]}</{tag.split()[0]}>" + MARK
                text = " ".join(words)
            return MARK + text

        close = rng.choice(["</p>", "</p>", "</p>", ""])
        body = rng.choice(["p", "p", "p", "p", "div", "br"])
        for _ in range(size):
            r = rng.random()
            if r < 0.07 and size > 2:
                level = rng.randint(2, 4)
                blocks.append(f"<h{level}>{MARK}{word(rng.randint(1, 6))}</h{level}>")
            elif r < 0.11 and size > 2:
                blocks.append("<ul>" + "".join(f"<li>{m(rng.randint(1, 2))}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif r < 0.14 and size > 2:
                blocks.append(f"<blockquote><p>{m(rng.randint(1, 3))}</p></blockquote>")
            elif r < 0.16 and size > 2:
                blocks.append("<table>" + "".join("<tr>" + "".join(f"<td>{MARK}{word(2)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(2, 4))) + "</table>")
            elif r < 0.18 and size > 2:
                blocks.append(f"<figure><img src=x><figcaption>{m()}</figcaption></figure>")
            else:
                n = 1 if short else rng.choice([1, 1, 2, 3, 4, 6])
                text = MARK + word() if rng.random() < 0.08 else inline(n)
                blocks.append(f"<p>{text}{close}" if body == "p" else f"<div>{text}</div>" if body == "div" else f"{text}<br><br>")
        within: list[Callable[[], str]] = [ad, share, related, form, ad]
        while rng.random() < 0.3:
            blocks.insert(rng.randint(0, len(blocks)), rng.choice(within)())
        head = rng.random()
        title = f"<h1>{MARK}{word(rng.randint(1, 8)) if rng.random() < 0.5 else say()}</h1>"
        if head < 0.7:
            blocks.insert(0, title if head < 0.55 else f"<header>{title}</header>")
        elif head < 0.8:
            blocks.insert(0, title.replace("h1", "h2"))
        inner = "\n".join(blocks)
        kind = rng.random()
        if plain:
            return f"<div{attr('content')}>{inner}</div>\n"
        if kind < 0.4:
            return f"<article{attr('content') if rng.random() < 0.5 else ''}>{inner}</article>\n"
        if kind < 0.55:
            return f"<main{attr('content') if rng.random() < 0.5 else ''}>{inner}</main>\n"
        if kind < 0.65:
            return f"<main><article{attr('content')}>{inner}</article></main>\n"
        tag = rng.choice(["div", "div", "section"])
        return f"<{tag}{attr('content')}>{inner}</{tag}>\n"

    before = [part() for part in (notice, header, nav, nav, form, ad, ad, share) if rng.random() < 0.4]
    after = [part() for part in (share, related, comments, comments, form, ad, side, footer, footer, notice, nav) if rng.random() < 0.4]
    middle = main()
    if rng.random() < 0.35:
        beside = [part() for part in (side, comments, related, ad, nav) if rng.random() < 0.5]
        cut = rng.randint(0, len(beside))
        middle = "".join(beside[:cut]) + middle + "".join(beside[cut:])
        middle = rng.choice(["<div{}>{}</div>", "<main{}>{}</main>" if not plain else "<div{}>{}</div>", "<table{}><tr><td>{}</td></tr></table>"]).format(rng.choice([' class="container"', ' id="wrapper"', "", ' class="layout"']), middle)
    body = "".join(before) + middle + "".join(after)
    if rng.random() < 0.3:
        body = f"<div{rng.choice([' class=page', ' id=site', '', ' class=wrap'])}>{body}</div>"
    return f"<!DOCTYPE html><html><head><title>{say()}</title><script>var a='<p>';</script></head><body>{body}" + rng.choice(["</body></html>", ""])
