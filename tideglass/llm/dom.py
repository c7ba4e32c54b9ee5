"""Block trees of HTML pages, and numbers that describe each block.

A node is a block element, or a run of text beside block elements in the same parent (`#text`). Inline elements belong
to the block around them. Comments, declarations, the head, scripts, styles and other elements whose content isn't
shown are no part of the tree. End tags that are missing, stray or crossed are borne as browsers bear them: a block
start closes an open paragraph, a list item or cell closes the one before it, the end of the page closes everything.
"""

from __future__ import annotations

import html
import math
import re

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
UNSEEN = frozenset("script style noscript template title textarea iframe object svg math canvas select option datalist audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var label wbr img input button nobr".split())
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
HOMES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "tbody": ("table",), "tfoot": ("table",)}

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTR = re.compile(r"""(id|class|role|aria-label|itemprop|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|\Z)""", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^a-zA-Z]+")

#: Kinds of attribute tokens, by how tokens begin.
KINDS = {
    "content": "content article post entry story main body text prose page",
    "nav": "nav menu crumb breadcrumb pagination pager tabs toc skip",
    "header": "header head masthead top branding logo hero",
    "footer": "footer foot bottom copyright colophon legal imprint",
    "side": "side sidebar aside widget rail secondary complementary column",
    "ad": "ad ads advert advertisement sponsor sponsored promo banner dfp outbrain taboola commercial",
    "notice": "cookie consent gdpr notice alert popup modal overlay dialog toast announcement warning privacy",
    "comment": "comment comments reply replies disqus respond discussion feedback review",
    "related": "related recommend recommended more trending popular similar teaser also latest",
    "share": "share sharing social tweet facebook follow like",
    "form": "form search newsletter subscribe signup login contact input",
    "meta": "meta byline author date tag tags category rating info",
}
_STEMS = [(k, tuple(w for w in words.split() if len(w) > 4), frozenset(words.split())) for k, (_, words) in enumerate(KINDS.items())]
GROUPS = ["article", "main", "section", "div", "p", "h", "list", "item", "table", "nav", "header", "footer", "aside", "form", "figure", "quote", "body", "#text"]
_GROUP = {"h1": "h", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "ul": "list", "ol": "list", "dl": "list", "menu": "list", "li": "item", "dt": "item", "dd": "item"}
_GROUP |= dict.fromkeys("table tbody thead tfoot tr td th caption center".split(), "table") | dict.fromkeys("fieldset legend".split(), "form") | dict.fromkeys("figure figcaption picture details summary".split(), "figure") | dict.fromkeys("blockquote pre address".split(), "quote") | {"html": "body", "dialog": "aside", "#root": "body"}
GROUP = {g: i for i, g in enumerate(GROUPS)} | {t: GROUPS.index(g) for t, g in _GROUP.items()}
_ABOVE = [GROUP[g] for g in ("article", "main", "nav", "header", "footer", "aside", "form", "item", "table")]
N_FEATURES = len(GROUPS) + len(_ABOVE) + 2 * len(KINDS) + 28


def kinds(tokens: str, known: dict[str, int]) -> int:
    """Bits of the kinds that attribute tokens are of."""
    found = known.get(tokens)
    if found is None:
        found = 0
        for token in _CAMEL.split(tokens):
            token = token.lower()
            for k, stems, exact in _STEMS:
                if token in exact or token.startswith(stems):
                    found |= 1 << k
        if len(known) < 100_000:
            known[tokens] = found
    return found


class Page:
    """The block tree of a page: tags, parents, attribute tokens, and texts (node, block, text, linked) in page order."""

    def __init__(self, source: str):
        self.tags: list[str] = ["#root"]
        self.parents: list[int] = [-1]
        self.tokens: list[str] = [""]
        self.hidden: list[bool] = [False]
        self.texts: list[tuple[int, int, str, bool]] = []
        self.block = 0
        stack: list[tuple[str, int]] = [("#root", 0)]  # open elements with their nodes; inline ones have their block's
        links = 0
        at = 0
        text = None  # the open #text node of the innermost block, or its own number while it has no block child
        parted: set[int] = set()
        while at < len(source):
            m = _TAG.search(source, at)
            stop = m.start() if m else len(source)
            if stop > at:
                run = html.unescape(source[at:stop])
                owner = stack[-1][1]
                if owner in parted and not run.isspace() and (text is None or self.parents[text] != owner):
                    text = self._add("#text", owner, "")
                if owner not in parted or not run.isspace():
                    self.texts.append((text if owner in parted else owner, self.block, run, links > 0))
                elif self.texts:
                    self.texts.append((self.texts[-1][0], self.block, run, False))
            if m is None:
                break
            at = m.end()
            closing, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            tag = name.lower()
            if closing:
                if tag == "p" and not any(t == "p" for t, _ in stack):
                    self.block += 1
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        for t, _ in stack[i:]:
                            links -= t == "a"
                            if t not in INLINE:
                                self.block += 1
                                text = None
                        del stack[i:]
                        break
                    if tag in INLINE and stack[i][0] not in INLINE:
                        break  # an inline end tag closes nothing beyond its block
                continue
            if tag == "br" or tag == "hr":
                self.block += 1
                continue
            if tag in UNSEEN or tag == "head":
                if not rest.endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}[\s/>]" + (r"|<body[\s>]" if tag == "head" else ""), re.I).search(source, at)
                    if end is None and tag in ("head", "select", "option"):
                        continue
                    at = len(source) if end is None else end.start()
                    if end is not None and source[at + 1] == "/":
                        at = source.find(">", at) + 1 or len(source)
                continue
            if tag in VOID:
                continue
            if tag in INLINE:
                if not rest.endswith("/"):
                    links += tag == "a"
                    stack.append((tag, stack[-1][1]))
                continue
            if tag == "html" or tag == "body" and any(t == "body" for t, _ in stack):
                continue
            self._close(stack, tag)
            links = sum(t == "a" for t, _ in stack)
            parent = stack[-1][1]
            attrs = [(a.lower(), x or y or z) for a, x, y, z in _ATTR.findall(rest)] if rest and not rest.isspace() else []
            hide = any(a == "hidden" or a == "aria-hidden" and v == "true" or a == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v) for a, v in attrs)
            node = self._add(tag, parent, " ".join(v for a, v in attrs if a not in ("style", "hidden", "aria-hidden")), hide)
            if parent not in parted:
                # Text that stood before the first block child becomes a node of its own.
                parted.add(parent)
                own = [i for i, t in enumerate(self.texts[-64:], max(0, len(self.texts) - 64)) if t[0] == parent]
                own = own if len(own) < 64 else [i for i, t in enumerate(self.texts) if t[0] == parent]
                if any(not self.texts[i][2].isspace() for i in own):
                    first = self._add("#text", parent, "")
                    for i in own:
                        self.texts[i] = (first, *self.texts[i][1:])
            self.block += 1
            text = None
            if not rest.endswith("/"):
                stack.append((tag, node))

    def _add(self, tag: str, parent: int, tokens: str, hidden: bool = False) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.tokens.append(tokens)
        self.hidden.append(hidden)
        return len(self.tags) - 1

    @staticmethod
    def _close(stack: list[tuple[str, int]], tag: str) -> None:
        """Ends what a block start tag ends: an open paragraph, and an item of the same list, row or table."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == "p":
                del stack[i:]
                break
            if stack[i][0] not in INLINE:
                break
        if tag in ITEMS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in HOMES[tag]:
                    break
                if stack[i][0] in ITEMS[tag]:
                    del stack[i:]
                    if tag not in ("tr", "tbody", "tfoot"):
                        break

    def text(self, keep: list[bool] | None = None) -> str:
        """Text of the kept nodes: white space within a block is one space, blocks are joined by one."""
        blocks: list[str] = []
        last, held = -1, []
        for node, block, run, _ in self.texts:
            if keep is None or keep[node]:
                if block != last and held:
                    blocks.append(" ".join("".join(held).split()))
                    held = []
                last = block
                held.append(run)
        blocks.append(" ".join("".join(held).split()))
        return " ".join(b for b in blocks if b)


def features(page: Page, known: dict[str, int]) -> tuple[list[int], list[list[float]]]:
    """Nodes that hold text, in page order (parents first), and their features."""
    n = len(page.tags)
    chars, linked, stops, leaves, first, last = [0] * n, [0] * n, [0] * n, [0] * n, [-1] * n, [0] * n
    total = 0
    for node, _, run, link in page.texts:
        size = len(run.strip())
        if size:
            if first[node] < 0:
                first[node] = total
            total += size
            last[node] = total
            chars[node] += size
            linked[node] += size if link else 0
            stops[node] += run.count(". ") + run.count(", ") + run.endswith(".")
    own = list(chars)
    blocks, inp, depth = [0] * n, [0] * n, [0] * n
    # Nodes that split text off their parent are added after its other children: parents always come first.
    for i in range(1, n):
        depth[i] = depth[page.parents[i]] + 1
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        if chars[i]:
            leaves[i] = leaves[i] or 1
            if page.tags[i] == "p":
                inp[i] = chars[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            stops[p] += stops[i]
            leaves[p] += leaves[i]
            inp[p] += inp[i]
            first[p] = first[i] if first[p] < 0 else min(first[p], first[i])
            last[p] = max(last[p], last[i])
        blocks[p] += blocks[i] + 1
    groups = [GROUP.get(t, GROUP["div"]) for t in page.tags]
    seen = [i for i in range(n) if chars[i]]
    children: dict[int, list[int]] = {}
    for i in seen[1:] if seen and seen[0] == 0 else seen:
        children.setdefault(page.parents[i], []).append(i)
    place: dict[int, int] = {}
    biggest: dict[int, int] = {}
    alike: dict[tuple[int, int], int] = {}
    for p, kids in children.items():
        kids.sort(key=lambda i: first[i])
        biggest[p] = max(kids, key=lambda i: chars[i])
        for k, i in enumerate(kids):
            place[i] = k
            alike[p, groups[i]] = alike.get((p, groups[i]), 0) + 1
    bits, above, up = [0] * n, [0] * n, [0] * n
    hidden = list(page.hidden)
    for i in range(n):
        bits[i] = kinds(page.tokens[i], known) if page.tokens[i] else 0
        if i:
            p = page.parents[i]
            above[i] = above[p] | bits[p]
            up[i] = up[p] | (1 << groups[p])
            hidden[i] = hidden[i] or hidden[p]
    deepest = max(depth) or 1
    log = math.log1p
    semantic = float(any(groups[i] in (0, 1) for i in seen))
    telling = float(any(bits[i] & 1 for i in seen))
    rows = []
    for i in seen:
        p = max(0, page.parents[i])
        kids = children.get(p, [i])
        k = place.get(i, 0)
        c, all_ = chars[i], max(1, total)
        group = [0.0] * len(GROUPS)
        group[groups[i]] = 1.0
        rows.append(
            group
            + [float(up[i] >> g & 1) for g in _ABOVE]
            + [float(bits[i] >> j & 1) for j in range(len(KINDS))]
            + [float(above[i] >> j & 1) for j in range(len(KINDS))]
            + [
                log(c), c / all_, linked[i] / c, log(blocks[i]), log(c / (1 + blocks[i])), float(depth[i]), depth[i] / deepest,
                float(k), float(len(kids)), k / len(kids), float(alike.get((p, groups[i]), 1)), max(0, first[i]) / all_, last[i] / all_, log(c / max(1, leaves[i])),
                inp[i] / c, stops[i] / c, own[i] / c, linked[p] / max(1, chars[p]), c / max(1, chars[p]), log(chars[kids[k - 1]]) if k else -1.0,
                log(chars[kids[k + 1]]) if k + 1 < len(kids) else -1.0, linked[kids[k - 1]] / max(1, chars[kids[k - 1]]) if k else -1.0, float(hidden[i]), float(biggest.get(p, i) == i),
                semantic, telling, log(total), inp[p] / max(1, chars[p]),
            ]
        )
    return seen, rows
