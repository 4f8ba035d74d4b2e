"""Blocks of pages against random trees, character references against the standard library."""

import html
import random

from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.operators import elements, pages


def test_nested_blocks():
    cases = {
        "<li>one<p>two</p>three</li>": ["one", "two", "three"],
        "<table><tr><td>a<p>b</p>c<td>d<table><tr><td>e</table>f</table>": ["a", "b", "c", "d", "e", "f"],
        "<p>a&#8212;b &eacute;&#x2019;&amp;lt; c": ["a—b \xe9’&lt; c"],
        "<p>one<p>two<b>bold</b>\n text<br>more": ["one", "twobold text more"],
        "x<nav><p>menu</nav><div>y</div>": ["x", "y"],
        "a<nav>never closed <p>b": ["a", "never closed", "b"],
        "a<script>if (1 < 2) { '<p>x</p>' }</script>b<style>p {}</style>": ["a", "b"],
        "<form><p>inside</form>out</p></div>": ["out"],
        "<!-- <p>no --><p title='a > b'>yes</p><![CDATA[z]]>": ["yes"],
        "": [], "   \n": [], "<p": ["<p"], "&nbsp;": [], "<li>a<blockquote>b<li>c</blockquote>d<li>e": ["a", "b", "c", "d", "e"],
    }
    assert {k: [t for _, t in elements.page_blocks(k)] for k in cases} == cases


def tree(r, depth):
    """A random tree of elements: its markup, and its blocks in page order."""
    name = r.choice(["div", "section", "li", "td", "blockquote", "dd"])
    inside, blocks, run = [], [], []

    def end():
        if run:
            blocks.append((name, " ".join(run)))
            run.clear()

    for _ in range(r.randrange(1, 5)):
        if depth and r.random() < 0.5:
            end()
            markup, more = tree(r, depth - 1)
            for child, frame in (("<li", "<ul>{}</ul>"), ("<td", "<table><tr>{}</tr></table>"), ("<dd", "<dl>{}</dl>")):
                if markup.startswith(child):
                    markup = frame.format(markup)
                    break
            if r.random() < 0.15:
                tag = r.choice(sorted(elements.BOILERPLATE - {"script", "style"}))
                inside.append(f"<{tag}>{markup}</{tag}>")
            else:
                inside.append(markup)
                blocks += more
        else:
            word = "".join(r.choices("abc\xe9—&<", k=r.randrange(1, 6)))
            coded = "".join(r.choice([html.escape(c), f"&#{ord(c)};", f"&#x{ord(c):x};"]) for c in word)
            inside.append(r.choice([" {} ", " <b>{}</b> ", " <a href='#'>{}</a> ", "\n{}\t"]).format(coded))
            run.append(word)
    end()
    return f"<{name}>{''.join(inside)}</{name}>", blocks


def test_random_trees():
    r = random.Random(1)
    for _ in range(600):
        markup, blocks = tree(r, 4)
        assert elements.page_blocks(markup) == blocks, markup


def test_articles(spark):
    long = "word " * 20
    rows = [(1, "u", f"<ul><li>one<p>{long}</p>three</li></ul><p>&#8212;&eacute;</p>"), (2, "u", "<div>short &hellip;</div>"), (3, None, None), (None, "v", "")]
    got = {r["page_id"]: r for r in pages.extract_articles(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert (got[1]["text"], got[1]["method"]) == (f"one\n{long.strip()}\nthree\n—\xe9", "blocks")
    assert (got[2]["text"], got[2]["method"], got[3]["text"], got[None]["text"]) == ("short …", "stripped", "", "")


def test_references(spark):
    r = random.Random(2)
    texts = [None, "", "no reference", "&amp;lt; &lt;b&gt; &quot;&#39;&#x27;&apos;", "&eacute;&Eacute;&hellip;&NotEqualTilde;&nosuch;", "&#8212;&#x2019;&#128512;&#0;&#55296;&#1114112;&#99999999999;", "&#128;&#150;&#129;&#7;&#13;", "a & b &; &# &#x; &#xg; &#12 x", "AT&amp;T&copy;&#169"]
    texts += ["".join(r.choices(["&amp;", "&#38;", "&#x26;", "lt;", "#65;", "&eacute;", "x", " ", "&", ";"], k=12)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for x in df.select("t", text.unescape_all(F.col("t")).alias("u")).collect():
        t, want = x["t"], None if x["t"] is None else html.unescape(x["t"])
        assert x["u"] == want, t
