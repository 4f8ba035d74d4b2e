"""Blocks of text out of raw pages: a tokenizer and a stack of open elements. A small helper for one page, run in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

#: Elements whose text is no article.
BOILERPLATE = frozenset("script style nav header footer aside form noscript iframe svg template".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Those of them whose text is an article's; text of others counts with the second strategy only.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li td th pre blockquote dd dt figcaption caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that is open is ended by the start of one of these.
ENDED_BY = {"p": BLOCKS - {"body", "html", "title"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}}
#: Elements across which a start tag reaches: cells and rows as far as their table, items and terms across these only.
ACROSS = {"td": BLOCKS - {"table"}, "th": BLOCKS - {"table"}, "tr": BLOCKS - {"table"}} | dict.fromkeys(("li", "dd", "dt"), frozenset({"address", "div", "p"}))


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[int] = []  # numbers of open elements
        self.names: list[str] = []
        self.closed: list[bool] = []
        self.parts: list[str] = []
        self.blocks: list[tuple[str, tuple[int, ...]]] = []

    def flush(self) -> None:
        text = "".join(self.parts)
        self.parts.clear()
        if text.strip(" \t\n\x0b\f\r"):
            self.blocks.append((text, tuple(self.open)))

    def handle_starttag(self, tag: str, attrs) -> None:
        self._end_before(tag)
        if tag in BLOCKS or tag in BOILERPLATE:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        if tag not in VOID:
            self.open.append(len(self.names))
            self.names.append(tag)
            self.closed.append(False)

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif tag in BLOCKS or tag in BOILERPLATE:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        place = next((k for k in range(len(self.open) - 1, -1, -1) if self.names[self.open[k]] == tag), None)
        if place is None:
            return  # nothing of this name is open
        if any(self.names[e] in BLOCKS or self.names[e] in BOILERPLATE for e in self.open[place:]):
            self.flush()
        self.closed[self.open[place]] = True
        del self.open[place:]

    def handle_data(self, data: str) -> None:
        self.parts.append(data)

    def _end_before(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            name = self.names[self.open[k]]
            if tag in ENDED_BY.get(name, ()):
                self.flush()
                self.closed[self.open[k]] = True
                del self.open[k:]
                return
            if name in BLOCKS and name not in ACROSS.get(tag, ()):
                return


def page_blocks(html: str) -> list[tuple[str, str]]:
    """(element, text) of all blocks outside boilerplate, in page order; the element is the innermost block that holds the text ('' for
    none). Character references are decoded, inline markup is dropped, white space is one space. Text after a nested block is a
    block of its own. Boilerplate that is never closed is none, or a page would end at it; scripts and styles always are."""
    page = _Page()
    page.feed(html)
    page.close()
    page.flush()
    out = []
    for text, holders in page.blocks:
        names = [page.names[e] for e in holders]
        if any(n in BOILERPLATE and (page.closed[e] or n in ("script", "style")) for n, e in zip(names, holders, strict=True)):
            continue
        body = " ".join(w for w in text.replace("\xa0", " ").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\f", " ").replace("\r", " ").split(" ") if w)
        if body:
            out.append((next((n for n in reversed(names) if n in BLOCKS or n == "caption"), ""), body))
    return out
