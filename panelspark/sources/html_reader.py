"""The per-page helper that runs inside tasks: one page's text and tables."""

from __future__ import annotations

import re
from bisect import bisect_left
from html.parser import HTMLParser


class _Tokens(HTMLParser):
    """A page as a flat list of (kind, payload) marks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.marks: list[tuple[str, object]] = []

    def handle_starttag(self, tag, attrs):
        self.marks.append(("open " + tag, attrs))

    def handle_startendtag(self, tag, attrs):
        if tag == "br":
            self.marks.append(("open br", attrs))

    def handle_endtag(self, tag):
        self.marks.append(("close " + tag, None))

    def handle_data(self, data):
        self.marks.append(("text", data))


def page_marks(html: str | None) -> list[tuple[str, object]]:
    reader = _Tokens()
    reader.feed(html or "")
    reader.close()
    return reader.marks


#: One letter for each mark that shapes a table; all other marks are dots.
_SIGNS = {
    "open tr": "R", "close tr": "r", "open td": "D", "open th": "H", "close td": "c", "close th": "c",
    "open br": "b", "text": "x", "open table": "T", "close table": "t",
}
_CELL = re.compile("[DH][^DHc]*c")
_ROW = re.compile("R[^Rr]*r")
_HEADING = re.compile("H[^DHc]*")
_HIDDEN = re.compile("S[^s]*s?")


def visible_words(marks: list[tuple[str, object]]) -> str:
    """All text outside of scripts and styles, white space squeezed."""
    hidden = {"open script": "S", "open style": "S", "close script": "s", "close style": "s"}
    signs = "".join(hidden.get(kind, "x" if kind == "text" else ".") for kind, _ in marks)
    cover = _HIDDEN.sub(lambda span: "." * len(span[0]), signs)
    return " ".join(" ".join(payload for sign, (_, payload) in zip(cover, marks) if sign == "x").split())


def page_tables(marks: list[tuple[str, object]]) -> list[dict]:
    """Tables in closing order; an unclosed one is dropped.

    The marks become a string of letters in which cells and rows are found as spans: a cell
    runs to the close that follows it with no other cell between, a row likewise.  What a
    span gives goes to the table that is innermost where the span ends.  A row with text
    in a heading cell, or with text in none, is no body row.
    """
    tables, inside, signs, innermost, closed = [], [], [], [], []
    for kind, payload in marks:
        sign = _SIGNS.get(kind, ".")
        if sign == "T":
            named = {key: value or "" for key, value in payload}
            inside.append(len(tables))
            tables.append({"id": named.get("id", ""), "classes": sorted(set(named.get("class", "").split())),
                           "header": [], "rows": []})
        signs.append(sign if inside or sign not in "RrDHt" else ".")
        innermost.append(inside[-1] if inside else None)
        if sign == "t" and inside:
            closed.append(inside.pop())
    line = "".join(signs)

    cells = []
    for span in _CELL.finditer(line):
        pieces = (marks[i][1] if line[i] == "x" else " " for i in range(*span.span()) if line[i] in "xb")
        cells.append((span.end() - 1, " ".join("".join(pieces).split())))
        if line[span.start()] == "H" and innermost[cells[-1][0]] is not None:
            tables[innermost[cells[-1][0]]]["header"].append(cells[-1][1])
    headed = [i for span in _HEADING.finditer(line) for i in range(*span.span()) if line[i] == "x"]
    ends = [i for i, sign in enumerate(line) if sign == "r"]
    for span in _ROW.finditer(line):
        end = span.end() - 1
        before = ends[bisect_left(ends, end) - 1] if ends[0] < end else -1
        row = [text for _, text in cells[bisect_left(cells, (span.start(),)):bisect_left(cells, (end,))]]
        if any(row) and bisect_left(headed, before) == bisect_left(headed, end):
            tables[innermost[end]]["rows"].append(row)
    return [tables[i] for i in closed]


def decode_declared(content: bytes | None, charset: str | None) -> str | None:
    """Bytes under the declared charset, else leniently as UTF-8; bad bytes are marked."""
    if content is None:
        return None
    for name in (charset, "utf-8"):
        try:
            return bytes(content).decode(name, errors="replace")
        except (LookupError, TypeError):
            continue
    return None
