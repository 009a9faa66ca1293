"""HTML as Markdown: a tokenizer that never fails, and a renderer with a stack of open elements.

Tokens are texts, start tags with attributes, end tags; comments, declarations and the contents of scripts and styles are dropped.
Character references of every kind are resolved. Headings, lists in lists, tables, preformatted blocks, quotes, links and images keep
their shape; all other text keeps its words, with runs of blanks as one. A page is worked on in a batch of pages, inside a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']?[^\s>]*)))?""")
#: Elements whose content is text up to their own end tag; in the first kind references are resolved, the second is dropped.
TEXT_ONLY, DROPPED = {"title", "textarea"}, {"script", "style"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = set("address article aside body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul blockquote caption".split())
#: Elements that a start tag closes when they are open, up to an element that bounds the search.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}),
}
_P_ENDS = BLOCKS - {"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "html", "head", "body", "title"}

Token = tuple[str, str, dict[str, str]]
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|([A-Za-z][A-Za-z0-9]*));")


def closed_references(text: str) -> str:
    """text with the references that a semicolon ends resolved; `&amp` at the end of a cut text stays as it is."""
    return _REFERENCE.sub(lambda m: unescape(m[0]) if m[1] is None or f"{m[1]};" in html5 else m[0], text)


def tokens(html: str, bare: bool = True) -> Iterator[Token]:
    """("text", text, {}), ("start", name, attributes) and ("end", name, {}) in order. bare: references need no semicolon."""
    resolved = unescape if bare else closed_references
    at, size = 0, len(html)
    held: list[str] = []

    def text() -> Iterator[Token]:
        if found := "".join(held):
            yield "text", resolved(found), {}
        held.clear()

    while at < size:
        less = html.find("<", at)
        if less < 0:
            held.append(html[at:])
            break
        held.append(html[at:less])
        if html.startswith("<!--", less):
            end = html.find("-->", less + 4) if not html.startswith(("<!-->", "<!--->"), less) else html.find(">", less) - 2
            at = size if end < 0 else end + 3
            yield from text()
            continue
        if html.startswith(("<!", "<?"), less):
            end = html.find(">", less)
            at = size if end < 0 else end + 1
            yield from text()
            continue
        tag = _TAG.match(html, less)
        if not tag:  # a sign, not a tag
            held.append("<")
            at = less + 1
            continue
        name, at, found = tag[2].lower(), tag.end(), {}
        while at < size and html[at] != ">":
            a = _ATTRIBUTE.match(html, at)
            if not a or a.end() == at:
                at += 1
                continue
            if a[1]:
                value = next((v for v in a.groups()[1:] if v is not None), "")
                found.setdefault(a[1].lower(), resolved(value))
            at = a.end()
        if at >= size:  # never closed: the page ends in it
            yield from text()
            return
        closed, at = html[at - 1] == "/", at + 1
        yield from text()
        if tag[1]:
            yield "end", name, {}
            continue
        yield "start", name, found
        if name in TEXT_ONLY | DROPPED and not closed:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            body = html[at : end.start() if end else size]
            if name in TEXT_ONLY and body:
                yield "text", resolved(body), {}
            yield "end", name, {}
            at = end.end() if end else size
    yield from text()


class _Table:
    def __init__(self) -> None:
        self.rows: list[list[str]] = []


class Markdown:
    """Lines from tokens; `open` holds the elements that are open, with what each needs."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.words: list[str] = []  # of the line that is being made
        self.open: list[str] = []
        self.lists: list[list] = []  # kind and number of each open list
        self.prefix = ""  # of the next line
        self.links: list[tuple[str, int]] = []
        self.tables: list[_Table] = []
        self.cells: list[list[str]] = []  # words of the outer cells
        self.pre = 0

    # -- lines

    def flush(self) -> None:
        text = re.sub(r"[ \t\n\r\f\v\xa0]+", " ", "".join(self.words)).strip() if not self.pre else "".join(self.words)
        self.words = []
        if self.cells:  # inside a cell lines are words
            if text:
                self.cells[-1].append(text)
            return
        if text:
            self.lines.append("> " * self.open.count("blockquote") + self.prefix + text)
            self.prefix = " " * len(self.prefix) if self.prefix.strip() in ("-",) or re.fullmatch(r"\s*\d+\. ", self.prefix) else ""

    def add(self, text: str) -> None:
        if self.pre and not self.cells:
            first, *rest = text.split("\n")
            self.words.append(first)
            for line in rest:
                self.lines.append("".join(self.words))
                self.words = [line]
        else:
            self.words.append(text)

    # -- tokens

    def take(self, kind: str, name: str, attributes: dict[str, str]) -> None:
        if kind == "text":
            if not (set(self.open) & DROPPED):
                self.add(name)
        elif kind == "start":
            self.start(name, attributes)
        else:
            self.end(name)

    def _closed_by(self, name: str) -> None:
        targets, bounds = CLOSES.get(name, (set(), set()))
        if name in _P_ENDS:
            targets, bounds = targets | {"p"}, bounds | {"li", "td", "th", "table", "blockquote", "div", "section", "article"}
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k] in targets:
                while len(self.open) > k:
                    self._leave(self.open[-1])
                if name not in CLOSES:
                    return
            elif self.open[k] in bounds:
                return

    def start(self, name: str, attributes: dict[str, str]) -> None:
        self._closed_by(name)
        if name in BLOCKS or name in ("br", "hr"):
            self.flush()
        if name == "hr":
            self.lines.append("---") if not self.cells else None
        elif name == "img" and attributes.get("src"):
            self.add(f"![{attributes.get('alt', '')}]({attributes['src']})")
        elif name in ("input", "meta", "link") or name in VOID:
            pass
        if name in VOID:
            return
        self.open.append(name)
        if name[0] == "h" and name[1:].isdigit() and len(name) == 2 and "1" <= name[1] <= "6":
            self.prefix = "#" * int(name[1]) + " "
        elif name in ("ul", "ol"):
            self.lists.append([name, int(attributes.get("start", "1")) if re.fullmatch(r"\d{1,9}", attributes.get("start", "1")) else 1])
        elif name == "li":
            depth = max(len(self.lists) - 1, 0)
            mark = "- "
            if self.lists and self.lists[-1][0] == "ol":
                mark = f"{self.lists[-1][1]}. "
                self.lists[-1][1] += 1
            self.prefix = "  " * depth + mark
        elif name == "pre":
            self.pre += 1
            self.lines.append("```") if not self.cells else None
        elif name == "a":
            self.links.append((attributes.get("href", ""), len(self.words)))
        elif name == "table":
            self.tables.append(_Table())
        elif name == "tr" and self.tables:
            self.tables[-1].rows.append([])
        elif name in ("td", "th") and self.tables:
            if not self.tables[-1].rows:
                self.tables[-1].rows.append([])
            self.cells.append([])

    def end(self, name: str) -> None:
        if name == "br":
            self.flush()
            return
        if name == "p" and "p" not in self.open:
            self.flush()
            return
        bound = {"table", "td", "th"} if name not in ("table", "tr", "td", "th", "thead", "tbody", "tfoot", "html", "body") else {"table"} - {name}
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k] == name:
                while len(self.open) > k:
                    self._leave(self.open[-1])
                return
            if self.open[k] in bound:
                return

    def _leave(self, name: str) -> None:
        """The innermost open element ends."""
        if name in BLOCKS:
            if name == "pre" and "".join(self.words):
                self.add("\n") if not self.cells else None
            self.flush()
        self.open.pop()
        if name in ("ul", "ol"):
            self.lists.pop()
            self.prefix = ""
        elif name == "li" or name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.prefix = ""
        elif name == "pre":
            self.pre -= 1
            self.lines.append("```") if not self.cells else None
        elif name == "a":
            href, at = self.links.pop()
            inner = re.sub(r"\s+", " ", "".join(self.words[at:])).strip()
            if at <= len(self.words) and inner and href:
                lead = " " if "".join(self.words[at:])[:1].isspace() else ""
                self.words[at:] = [f"{lead}[{inner}]({href})"]
        elif name in ("td", "th") and self.cells and self.tables:
            self.tables[-1].rows[-1].append(" ".join(self.cells.pop()).replace("|", "\\|"))
        elif name == "table" and self.tables:
            self._table(self.tables.pop())

    def _table(self, table: _Table) -> None:
        rows = [r for r in table.rows if any(r)]
        width = max(map(len, rows), default=0)
        if self.cells:  # a table in a cell becomes its words
            self.cells[-1] += [" ".join(filter(None, r)) for r in rows]
            return
        for k, row in enumerate(rows):
            self.lines.append("| " + " | ".join(row + [""] * (width - len(row))) + " |")
            if k == 0:
                self.lines.append("|" + " --- |" * width)

    def text(self) -> str:
        while self.open:
            self._leave(self.open[-1])
        self.flush()
        return "\n".join(self.lines)


def to_markdown(html: str, bare: bool = True) -> str:
    page = Markdown()
    for token in tokens(html, bare):
        page.take(*token)
    return page.text()


def html_markdown(html: Column | str, bare: bool = True) -> Column:
    """A page as Markdown lines; null is an empty page. bare: references without a semicolon are resolved, as browsers do."""

    def run(pages: pa.Array) -> pa.Array:
        return pa.array([to_markdown(p.as_py() or "", bare) for p in pages], pa.string())

    return F.arrow_udf(run, "string")(html)
