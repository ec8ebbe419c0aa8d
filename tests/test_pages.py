"""Answer pages against a tree that the standard library's parser builds."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from rawi.functions import pages as P


class Tree(HTMLParser):
    """Nodes as [name, classes, parent, children]; a child is a node, a text, or None for a break."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = self.at = ["", set(), None, []]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, set((dict(attrs).get("class") or "").split()), self.at, []]
        self.at[3].append(node)
        if tag not in P.VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in P.VOID:
            self.at = self.at[2]

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node[0] != tag:
            node = node[2]
        if node is not None and node[2] is not None:
            self.at = node[2]

    def handle_data(self, data):
        self.at[3].append(data)

    def walk(self, node):
        for child in node[3]:
            if isinstance(child, list):
                yield child
                yield from self.walk(child)

    def find(self, cls, node):
        return [n for n in self.walk(node) if n[0] == "div" and cls in n[1]]


def inside(node, test):
    while node is not None:
        if test(node):
            return True
        node = node[2]
    return False


def flat(node):
    return "" if node[0] in P.HIDDEN else "".join(c if isinstance(c, str) else flat(c) for c in node[3])


def shown(node):
    out = ""
    for c in node[3]:
        if isinstance(c, str):
            out += c
        elif c[0] == "p":
            out += "\n" + flat(c) + "\n"
        elif c[0] == "br":
            out += "\n"
        elif c[0] not in P.HIDDEN:
            out += shown(c)
    return out


def lines(node):
    return "\n".join(x for x in (x.strip() for x in shown(node).split("\n")) if x)


def brute(html):
    t = Tree(html)
    response = thinking = ""
    for top in t.find("response", t.root)[:1]:
        model = t.find("model-response-text", top)
        found = t.find("markdown", model[0]) if model else [m for m in t.find("markdown", top) if not inside(m[2], lambda n: n[0] == "model-thoughts" or n[0] == "div" and "thinking" in n[1])]
        response = lines(found[0]) if found else ""
    for top in t.find("thinking", t.root)[:1]:
        found = t.find("markdown", top)
        thinking = P.sections(lines(found[0])) if found else ""
    return response, thinking


def made(rng):
    """Pages with tags that are not closed, closed twice, in the wrong order, or void."""
    out = []
    for _ in range(rng.randint(1, 60)):
        cls = rng.choice(["response", "thinking", "markdown", "model-response-text", "markdown x", "a  response", "none"])
        out.append(
            rng.choice([
                f'<div class="{cls}">', f"<DIV class='{cls}'>", f"<div data-x='class=no' id=1 class={cls.split()[0]}>", "<div>", "<div/>", "</div>", "</div>", "</div>", "<p>", "</p>", "<p class=markdown>", "<br>", "<br/>", "<img src='a>b'>", "<b>", "</b>", "</i>",
                "<model-thoughts>", "</model-thoughts>", "text &amp; more &lt;b&gt;\n", " \n ", "&eacute;t&#233; &nope; &#x41;", "<!-- <div class='response'> -->", "<script>var a = '</div>' + \"<p>\";</script>", "<style>p { }</style>", "a < b", "Analyzing it\n", "**bold**\n", "  line\n", "<span>", "</span>",
            ])
        )
    return "".join(out)


def test_broken_pages_like_the_standard_parser():
    rng = random.Random(8)
    some = 0
    for _ in range(6000):
        html = made(rng)
        assert P.answer(html) == brute(html), html
        some += P.answer(html) != ("", "")
    assert some > 300


def test_a_page_by_hand(spark):
    html = """<div class="response"><div class="thinking"><div class="markdown"><p>Analyzing <b>it</b></p><p>more<br>of it</p>**Next**</div></div>
      <div class="model-response-text"><div class="markdown"><p>one &amp; <i>two</p>three<br>four<script>x</script><p></p>five</div></div></div>"""
    got = spark.createDataFrame([(html,), ("",), (None,), ("plain",)], "h string").select(P.answer_texts(F.col("h")).alias("a")).select("a.*").collect()
    assert tuple(got[0]) == ("one & two\nthree\nfour\nfive", "Analyzing it\nmoreof it\n\n**Next**")
    assert [tuple(r) for r in got[1:]] == [("", ""), (None, None), ("", "")]


@pytest.mark.parametrize("n", [20_000])
def test_deep_nesting_takes_linear_time(n):
    html = '<div class="response"><div class="markdown">' + "<b>x" * 100 + "</div></div>" + "<div>" * n + "</i>" * n
    assert P.answer(html)[0] == "x" * 100
