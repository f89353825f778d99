"""Main-text extraction: parts of a page that must stay, and densities of a tree built another way."""

import math
from html.parser import HTMLParser

import pytest

from feedrank.llm import html_text

P = "A sentence of the article with quite a few words in it, and some more of them. "
ONE = P.strip()


def _body(inner):
    links = "".join(f"<li><a href=/{i}>menu entry {i}</a></li>" for i in range(8))
    return f"<html><body><nav><ul>{links}</ul></nav>{inner}<footer><p>{P}</p></footer></body></html>"


def test_equal_boxes_of_the_body_all_stay():
    box = "<div>" + f"<p>{P}</p>" * 5 + "</div>"
    menu = "<ul>" + "".join(f"<li><a href=/{i}>elsewhere {i}</a></li>" for i in range(9)) + "</ul>"
    assert html_text.main_text(_body(box + menu + box)) == "\n\n".join([ONE] * 10)


def test_link_lists_and_cells_of_the_article_stay():
    inner = (f"<article><h1>Title</h1><p>{P}</p><ul><li><a href=a>First source</a></li><li><a href=b>Second</a></li></ul>"
             f"<table><tr><td><a href=p>Paris</a></td><td>2</td></tr></table><p>{P}</p></article>")
    assert html_text.main_text(_body(inner)) == "\n\n".join(["Title", ONE, "First source", "Second", "Paris", "2", ONE])


@pytest.mark.parametrize("name", ["no-sidebar", "has-ad", "article-with-comments", "content social-history", "cookie-recipes", "menus-of-paris"])
def test_names_match_whole_tokens(name):
    inner = f"<div class='{name}'>" + f"<p>{P}</p>" * 4 + "</div>"
    assert html_text.main_text(_body(inner)) == "\n\n".join([ONE] * 4)


@pytest.mark.parametrize("name", ["sidebar", "wide Comments", "ad", "cookie-notice"])
def test_named_parts_go_unless_they_hold_the_article(name):
    inner = f"<div><p>{P}</p><p>{P}</p></div><div class='{name}'><p>{P * 5}</p></div>"
    assert html_text.main_text(_body(inner)) == f"{ONE}\n\n{ONE}"
    held = f"<div class='{name}'><article><p>{P}</p></article></div>"
    assert html_text.main_text(_body(held)) == ONE


class _Tree(HTMLParser):
    """Nodes ``[tag, parent, own characters]`` of well-formed markup."""

    def __init__(self):
        super().__init__()
        self.nodes, self.stack = [["#root", None, 0]], [0]

    def handle_starttag(self, tag, attrs):
        self.nodes.append([tag, self.stack[-1], 0])
        self.stack.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.nodes[self.stack[-1]][2] += len(" ".join(data.split()))


def test_the_core_is_the_node_of_maximum_density_sum():
    """The densest box among boxes of differing length and link share, found by sums over a tree parsed by the standard library."""
    boxes = [(1, 0), (6, 1), (2, 5), (3, 3)]
    inner = "".join("<div>" + f"<p>{'w%d ' % k * 30}</p>" * a + f"<p><a>{'l%d ' % k * 30}</a></p>" * b + "</div>" for k, (a, b) in enumerate(boxes))
    page = f"<html><body>{inner}</body></html>"
    t = _Tree()
    t.feed(page)
    n = len(t.nodes)

    def below(i):
        return [j for j in range(n) if j != i and _under(j, i)]

    def _under(j, i):
        while j is not None and j != i:
            j = t.nodes[j][1]
        return j == i

    def linked(j):
        while j is not None:
            if t.nodes[j][0] == "a":
                return True
            j = t.nodes[j][1]
        return False

    def facts(i):
        own = [i, *below(i)]
        return (sum(t.nodes[j][2] for j in own), max(len(own) - 1, 1), sum(t.nodes[j][2] for j in own if linked(j)),
                sum(t.nodes[j][0] == "a" for j in own if j != i))

    body = next(i for i in range(n) if t.nodes[i][0] == "body")
    cb, _, lb, _ = facts(body)

    def density(i):
        c, tags, lc, lt = facts(i)
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + lb / cb * c + math.e)
        arg = c / max(lc, 1) * (tags / max(lt, 1))
        return c / tags * max(math.log(arg) / math.log(base), 0.0)

    sums = {i: sum(density(j) for j in range(n) if t.nodes[j][1] == i) for i in range(n)}
    core = max((i for i in range(n) if _under(i, body)), key=lambda i: (sums[i], -i))
    path = [core]
    while path[-1] != body:
        path.append(t.nodes[path[-1]][1])
    least = min(density(i) for i in path)
    kids = [i for i in range(n) if t.nodes[i][1] == body]
    kept = [k for k, i in enumerate(kids) if core == body or i == path[-2] or density(i) >= least]
    got = html_text.main_text(page)
    assert [k for k in range(len(boxes)) if f"w{k}" in got] == kept


def test_long_pages_and_deep_trees():
    many = "<article>" + f"<p>{P}</p>" * 20_000 + "</article>"
    assert html_text.main_text(_body(many)) == "\n\n".join([ONE] * 20_000)
    assert html_text.main_text("<div class=ad>" * 3000 + "x" + "</div>" * 3000) == ""
