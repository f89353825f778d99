"""Main-text extraction by composite text density.

A page is read into a flat pre-order DOM (unclosed paragraphs, list items and
table cells end as browsers end them).  For every node the characters ``C``,
tags ``T``, link characters ``LC`` and link tags ``LT`` below it give its
composite density ::

    C / T * log( C * T / (LC * LT), base ln( C * LC / (C - LC) + LCb * C / Cb + e ) )

where ``b`` is the body and zeros count as one: characters per tag, lowered
where text sits in links.  A node's density sum is that of its children.  The
node of maximum sum is the core of the article; the lowest density on its path
from the body is the threshold.  The article is the ``article`` or ``main``
around the core, or else every part of the body that reaches the threshold, the
core's own among them.  Parts that are never the article (menus, page headers and
footers, sidebars, notices, adverts, forms, comments, scripts) are known by tag,
role, or a whole class token or id -- unless an article or first heading stands
in them -- and count for nothing.  Lists and boxes that are mostly links are left
out around the core, but not inside it or the ``article``.

Blocks are the texts between block-level tags, white space folded to one space
and trimmed, joined by two line feeds in page order.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, map_batches, text_or_empty

# Element groups of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe template textarea title xmp noembed noframes svg math object canvas".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp
small span strike strong sub sup time tt u var wbr""".split())
ENDS_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul""".split())
SCOPE = frozenset("article aside body caption div footer header html main section table td th ul ol dl nav form".split())
# a start tag of the key ends an open element of its group, up to the nearest scope element outside the group
ENDS_ITEM = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
             "option": ("option",), "optgroup": ("option", "optgroup")}
ITEM_SCOPE = {"li": ("ul", "ol", "menu", "body"), "dt": ("dl", "body"), "dd": ("dl", "body"), "tr": ("table", "body"),
              "td": ("table", "tr", "body"), "th": ("table", "tr", "body"), "option": ("select", "body"), "optgroup": ("select", "body")}
NOT_ARTICLE = frozenset("nav footer aside form button select menu dialog fieldset head".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
BOXES = frozenset("ul ol dl div section table tbody tr td".split())
# class tokens and ids of parts that are no article, each matched as a whole
NAMES = frozenset("""ad ads advert adverts advertisement advertising adsense adbox ad-banner ad-container banner sponsor sponsored promo
promotion cookie cookies cookie-notice cookie-banner cookie-consent cookie-bar consent gdpr notice notices notification notifications alert
alerts nav navbar navigation main-nav site-nav menu main-menu breadcrumb breadcrumbs sidebar side-bar aside widget widgets widget-area footer
foot site-footer page-footer masthead topbar top-bar site-header page-header comment comments commentlist comment-list comments-area
comment-section user-comments reader-comments disqus disqus_thread respond replies reply related related-posts related-articles recommended
recommendations share sharing share-buttons social social-links social-media social-share newsletter subscribe subscription signup sign-up
login popup modal overlay toolbar pagination pager skip-link""".split())

_TOKEN = re.compile(r"<(?:!--(?P<c>)|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|[!?/])")
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class _Page:
    """Flat DOM: per node its tag, parent and last descendant; texts and block ends in page order."""

    def __init__(self, html: str):
        self.tag, self.parent, self.dead = ["#root"], [-1], [False]
        self.last: list[int] = [0]
        self.events: list[tuple[int, str | None]] = []       # (node, text, or None where a block ends)
        self.named: list[int] = []           # nodes with a name of NAMES
        self.heads: list[int] = []           # articles, mains and first headings
        self._read(html)
        heads = [x for x in self.heads if not self.dead[x]]
        for node in self.named:              # a name does not decide against an article or headline inside
            k = bisect_right(heads, node)
            if not self.dead[node] and not (k < len(heads) and heads[k] <= self.last[node]):
                for i in range(node, self.last[node] + 1):
                    self.dead[i] = True

    def _open(self, tag: str, dead: bool, stack: list[int]) -> int:
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(stack[-1])
        self.dead.append(dead or self.dead[stack[-1]])
        self.last.append(node)
        return node

    def _close_to(self, stack: list[int], names: tuple[str, ...] | frozenset, scope) -> None:
        """End the nearest open element of ``names``, unless one of ``scope`` stands before it."""
        for k in range(len(stack) - 1, 0, -1):
            t = self.tag[stack[k]]
            if t in names:
                for n in stack[k:]:
                    self.last[n] = len(self.tag) - 1
                del stack[k:]
                self.events.append((stack[-1], None))
                return
            if t in scope:
                return

    def _text(self, raw: str, node: int) -> None:
        if raw:
            self.events.append((node, unescape(raw) if "&" in raw else raw))

    def _read(self, html: str) -> None:
        stack, at, n = [0], 0, len(html)
        lower = None
        while at < n:
            m = _TOKEN.search(html, at)
            if m is None:
                tail = html[at:]
                cut = re.search(r"<[a-zA-Z/!?]", tail)       # a tag the page breaks off in
                self._text(tail[:cut.start()] if cut else tail, stack[-1])
                break
            self._text(html[at:m.start()], stack[-1])
            at = m.end()
            if m["tag"] is None:
                close = html.find("-->", at) if m["c"] is not None else html.find(">", at)
                at = n if close < 0 else close + (3 if m["c"] is not None else 1)
                continue
            tag = m["tag"].lower()
            if m["end"]:
                if tag in ("p", "br"):
                    self.events.append((stack[-1], None))
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == tag:
                        for x in stack[k:]:
                            self.last[x] = len(self.tag) - 1
                        del stack[k:]
                        break
                if tag not in INLINE:
                    self.events.append((stack[-1], None))
                continue
            if tag in ENDS_P:
                self._close_to(stack, ("p",), SCOPE)
            if tag in ENDS_ITEM:
                self._close_to(stack, ENDS_ITEM[tag], ITEM_SCOPE[tag])
            dead = tag in RAW or tag in NOT_ARTICLE or (tag == "header" and not any(self.tag[x] in ("article", "main") for x in stack))
            attr, named = m["attr"], False
            if attr and not dead and tag not in ("html", "body", "article", "main"):
                for a in _ATTR.finditer(attr):
                    name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                    if name in ("class", "id"):
                        named = named or not NAMES.isdisjoint(value.lower().split())
                    elif name == "role":
                        dead = dead or value.lower() in ROLES
                    else:
                        dead = dead or name == "hidden" or value.lower() == "true"
            node = self._open(tag, dead, stack)
            if named:
                self.named.append(node)
            if tag in ("article", "main", "h1"):
                self.heads.append(node)
            if tag == "br":
                self.events.append((node, " "))
            elif tag not in INLINE:
                self.events.append((stack[-1], None))
            if tag in VOID or attr.endswith("/") and tag not in ENDS_P and tag not in SCOPE:
                continue
            if tag in RAW:                                   # its content is not markup
                if lower is None:
                    lower = html.lower()
                close = lower.find("</" + tag, at)
                if close < 0:
                    at = n
                else:
                    end = html.find(">", close)
                    at = n if end < 0 else end + 1
                continue
            stack.append(node)
        for x in stack:
            self.last[x] = len(self.tag) - 1


def _density(c: int, t: int, lc: int, lt: int, body_c: int, body_lc: int) -> float:
    if not c:
        return 0.0
    t, lc1, lt = max(t, 1), max(lc, 1), max(lt, 1)
    base = math.log(c / max(c - lc, 1) * lc + body_lc / max(body_c, 1) * c + math.e)
    arg = c / lc1 * (t / lt)
    if base <= 1.0 + 1e-12:                                  # no link on the page: the base is ln e
        base = 1.0 + 1e-6 if arg < 1 else math.e
    return c / t * max(math.log(max(arg, 1e-9)) / math.log(base), 0.0)


def main_text(html: str) -> str:
    """Main text of one whole page ("" if it has none)."""
    if not html:
        return ""
    page = _Page(html)
    n = len(page.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = page.tag[i] == "a" or in_link[page.parent[i]]
    for node, text in page.events:
        if text is not None and not page.dead[node]:
            size = len(" ".join(text.split()))
            chars[node] += size
            if in_link[node]:
                link_chars[node] += size
    for i in range(n - 1, 0, -1):
        if page.dead[i]:
            continue
        p = page.parent[i]
        chars[p] += chars[i]
        link_chars[p] += link_chars[i]
        tags[p] += tags[i] + 1
        link_tags[p] += link_tags[i] + (page.tag[i] == "a")
    body = page.tag.index("body") if "body" in page.tag else 0
    if not chars[body]:
        body = 0
    if not chars[body]:
        return ""
    cb, lcb = chars[body], link_chars[body]
    density = [0.0 if page.dead[i] else _density(chars[i], tags[i], link_chars[i], link_tags[i], cb, lcb) for i in range(n)]
    total = [0.0] * n
    for i in range(1, n):
        total[page.parent[i]] += density[i]
    inside = range(body, page.last[body] + 1 if body else n)
    core = max((i for i in inside if not page.dead[i]), key=lambda i: (total[i], -i))
    path = [core]
    while path[-1] != body:
        path.append(page.parent[path[-1]])
    article = next((i for i in path if page.tag[i] in ("article", "main")), None)
    if article is not None:
        tops, inner = [article], article
    elif core == body:
        tops, inner = [body], body
    else:
        threshold = min(density[i] for i in path)
        tops = [i for i in inside if page.parent[i] == body and i != body and not page.dead[i] and (i == path[-2] or density[i] >= threshold)]
        inner = core
    # boxes that are mostly links, around the core but not in it
    keep = [False] * n
    for top in tops:
        keep[top] = True
        for i in range(top + 1, (page.last[top] if top else n - 1) + 1):
            keep[i] = keep[page.parent[i]] and not page.dead[i] and not (
                page.tag[i] in BOXES and link_chars[i] * 10 > chars[i] * 6 and not inner <= i <= (page.last[inner] if inner else n - 1))
    blocks: list[str] = []
    piece: list[str] = []
    for node, text in page.events:
        if text is None:
            if piece:
                blocks.append("".join(piece))
                piece = []
        elif keep[node]:
            piece.append(text)
    if piece:
        blocks.append("".join(piece))
    return "\n\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row.

    Null and empty pages give the empty text; null ids and urls pass through;
    equal rows are extracted one by one; an empty table gives no row.
    """
    src = df.select(col(id_col).alias("page_id"), col(url_col).alias("url"), text_or_empty(html_col).alias("html"))

    def run(cols: dict) -> dict:
        text = [main_text(h) for h in cols["html"]]
        return {"page_id": cols["page_id"], "url": cols["url"], "text": text, "n_chars": [len(t) for t in text]}

    types = {f.name: f.dataType.simpleString() for f in src.schema}
    return map_batches(src, run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
