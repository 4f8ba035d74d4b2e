"""Page parsing and tree scoring: odd markup, against a plain version that walks all ancestors, and its time."""

import random
import time

import pytest

from threadloom.llm import html_text as h

LONG = "A paragraph, with commas, of one article. " * 9


def plainly(page):
    """Scores by walking all ancestors of every block."""
    root = h.parse(page)
    found = h.blocks(root) or h.blocks(h._without_soft(root))

    def up(x):
        while x is not None:
            yield x
            x = x.parent

    text, linked, points = {}, {}, {}
    for owner, t, n in found:
        for x in up(owner):
            text[x] = text.get(x, 0) + len(t)
            linked[x] = linked.get(x, 0) + n
        holder = owner if owner.tag in h.CONTAINERS or owner.parent is None else owner.parent
        for x, share in zip(up(holder), (1, 0.5), strict=False):
            points[x] = points.get(x, 0) + share * h.points_of(t)
    if not found:
        return ""
    score = {x: points.get(x, 0) * (1 - linked[x] / text[x]) for x in text}
    top = max(score.values())
    best = next(x for x in h.sums(root, found) if score.get(x, 0.0) == top)
    best = next(x for x in up(best) if x.tag in h.CONTAINERS or x.parent is None)
    path = list(up(best))
    articles = [i for i, x in enumerate(path) if x.tag == "article"]
    whole = articles[-1] if articles else 0
    clear = [i for i, x in enumerate(path) if 2 * linked[x] < text[x]]
    named = [i for i, x in enumerate(path) if x.tag in ("article", "main") and (i == whole or i in clear)]
    last = min(max((named or clear or [0])[-1], whole) + 1, len(path) - 1)
    kept = []
    for owner, t, _ in found:
        line = list(up(owner))
        if path[whole] in line:
            kept.append(t)
            continue
        meets = next((i for i, x in enumerate(line) if x in path[whole + 1 : last + 1]), None)
        if meets == 0 or (meets and 2 * linked[line[meets - 1]] < text[line[meets - 1]]):
            kept.append(t)
    return "\n".join(kept)


def random_page(r):
    names = ["div", "p", "section", "article", "main", "ul", "li", "a", "b", "table", "tr", "td", "h2", "nav", "blockquote", "span"]
    classes = ["", "", "", ' class="sidebar"', ' class="comments"', ' id="content"', " class=it's", ' title="a > b"', ' class="ad-box"']
    out = []
    for _ in range(r.randrange(5, 60)):
        kind = r.random()
        if kind < 0.45:
            out.append(f"<{r.choice(names)}{r.choice(classes)}>")
        elif kind < 0.7:
            out.append(f"</{r.choice(names)}>")
        else:
            out.append(r.choice(["Some words, and more. ", "x", "A longer stretch of text, with commas, which scores. " * r.randrange(1, 6), " &amp; ", "<br>"]))
    return "".join(out)


def test_scores_against_the_plain_version():
    r = random.Random(2)
    for _ in range(1500):
        page = random_page(r)
        assert h.main_text(page) == plainly(page), page


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<p class=it's>{LONG}</p><p>it's b</p>", "L\nit's b"),
        (f'<p title=5">{LONG}</p><p>x "q" y</p>', 'L\nx "q" y'),
        (f'<p title="never closed>{LONG}</p>', "L"),
        (f"<p title = 'a > b'>{LONG}</p>", "L"),
        (f"<article><p>{LONG}</p><template><p>a<template>b</template>c</p></template><p>end</p></article>", "L\nend"),
        (f"<article><p>{LONG}</p><svg><svg><text>x</text></svg><text>y</text></svg><p>end</p></article>", "L\nend"),
        (f"<!--><p>{LONG}</p><!-- x", "L"),
        (f"<p>{LONG}</p><p>a < b and c > d</p>", "L\na < b and c > d"),
        (f'<p class="social-science">{LONG}</p><p class="sharing-economy">b</p>', "L\nb"),
        (f"<article><div>{LONG}</div><div>Lead.</div><h3>Part</h3><div>{LONG}</div></article>", "L\nLead.\nPart\nL"),
        ("<div>" * 50 + "deep" + "</div>" * 50, "deep"),
        ("<p>a</p>" * 3, "a\na\na"),
    ],
)
def test_markup(page, text):
    assert h.main_text(page).replace(LONG.strip(), "L") == text


@pytest.mark.parametrize("unit", ["<div>x, y", "<div class=sidebar><p>x, y", "<b><p>x", "<i></p></section>x", '<p x="', "<a =' ", "<table><tr><td>x"])
def test_time_grows_with_length_alone(unit):
    began = time.process_time()
    h.main_text(unit * 60_000)
    assert time.process_time() - began < 10


def test_pages_in_wrappers():
    """Pages that are one form, or hidden until a script runs, keep their text; forms and hidden texts beside an article do not."""
    text = "A sentence of the article, with some words in it, that goes on for a while."
    body = "".join(f"<p>{text} {i}</p>" for i in range(6))
    want = "\n".join(f"{text} {i}" for i in range(6))
    form = "<form><label>Name</label><p>Fill this in.</p><input><button>Send</button></form>"
    assert h.main_text(f"<body><form id='aspnetForm'><div class='content'>{body}</div></form></body>") == want
    assert h.main_text(f"<body><form><main>{body}</main></form></body>") == want
    assert h.main_text(f"<body><div hidden><div>{body}</div></div><p>Enable scripts.</p></body>").startswith(want)
    assert h.main_text(f"<body><article>{body}</article><div style='display:none'><p>{text * 20}</p></div>{form}</body>") == want
    assert h.main_text(f"<body><div>{body}</div>{form}</body>") == want
    assert h.main_text(f"<body>{form}</body>") == ""


def test_marks_with_a_prefix():
    text = "A sentence of the article, with some words in it, that goes on for a while."
    body = "".join(f"<p>{text} {i}</p>" for i in range(6))
    want = "\n".join(f"{text} {i}" for i in range(6))
    for name in ("user-comments", "reader-comments", "post-footer", "article-share", "entry-related", "post_navigation", "story-sidebar"):
        assert h.main_text(f"<body><div>{body}<div class='{name}'><p>reader says, something, else</p></div></div></body>") == want, name
    assert h.main_text(f"<body><div class='post-header'><h1>Title</h1></div><div>{body}</div></body>") == "Title\n" + want
