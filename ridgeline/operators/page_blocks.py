"""Blocks of text in web pages, by an Arrow table function: one page to many rows.

Markup is read as browsers' tokenizers do in the main, with a defined end for
everything that is broken:

* a comment, declaration, tag or quoted attribute that is never closed runs to
  the end of the page; ``<`` before anything else is text;
* what scripts and styles hold is no text, up to their end tag or the page's end;
* a start or end tag of a block element ends the block before it; an end tag
  that closes nothing does no more than that, and an element that is never
  closed ends with the page;
* p, li, dt, dd, tr, td, th and option end an open element of their own name.

References are resolved within each run of text, blanks are collapsed, ``br`` is
a blank, and blocks without text are left out.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import BLANKS
from ..session import ship_package

OUT = "page_id long, block int, tag string, text string, n_words long, n_chars long, link_chars long, n_links long, link_share double, density double, begin long, place double"
#: Elements that end a block, those of them that do not nest, and those without text.
BLOCKS = frozenset(
    "html head body title div p ul ol li dl dt dd table caption thead tbody tfoot tr td th section article aside main header footer nav "
    "h1 h2 h3 h4 h5 h6 blockquote pre form fieldset legend figure figcaption address hr select option details summary".split()
)
FLAT = frozenset("p li dt dd tr td th option".split())
HIDDEN = frozenset(("script", "style"))
VOID = frozenset(("hr",))
ROOT = "page"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*(?:>|\Z)""",
    re.DOTALL | re.ASCII,
)
_RUN = re.compile(f"[{BLANKS}]+")


class _Page:
    """Blocks of one page, as tuples in the order of the columns after block."""

    def __init__(self, source: str):
        self.source, self.found = source, []
        self.open: list[str] = []
        self.counts: Counter[str] = Counter()  # of names in it
        self.clear()

    def clear(self) -> None:
        self.pieces: list[str] = []
        self.linked, self.links, self.in_link = 0, 0, False
        self.begin = self.end = -1

    def text(self, begin: int, end: int) -> None:
        if end <= begin:
            return
        piece = html.unescape(self.source[begin:end])
        solid = len(_RUN.sub("", piece))
        self.pieces.append(piece)
        if solid:
            self.begin, self.end = (begin if self.begin < 0 else self.begin), end
            self.linked += solid * self.in_link

    def flush(self) -> None:
        text = _RUN.sub(" ", "".join(self.pieces)).strip(" ")
        if text:
            solid = len(text) - text.count(" ")
            tag = self.open[-1] if self.open else ROOT
            self.found.append((
                tag, text, text.count(" ") + 1, solid, self.linked, self.links, self.linked / solid,
                solid / max(solid, self.end - self.begin), self.begin, self.begin / len(self.source),
            ))
        self.clear()

    def tag(self, name: str, closing: bool) -> None:
        if name == "a":
            self.in_link = not closing
            self.links += not closing
        elif name == "br":
            self.pieces.append(" ")
        elif name in BLOCKS:
            self.flush()
            if closing:
                while self.counts[name]:
                    last = self.open.pop()
                    self.counts[last] -= 1
                    if last == name:
                        break
            elif name not in VOID and not (name in FLAT and self.open and self.open[-1] == name):
                self.open.append(name)
                self.counts[name] += 1

    def blocks(self) -> list[tuple]:
        at = 0
        while token := _TOKEN.search(self.source, at):
            self.text(at, token.start())
            at = token.end()
            if token["name"]:
                name = token["name"].lower()
                self.tag(name, bool(token["end"]))
                if name in HIDDEN and not token["end"]:
                    close = re.compile(f"</{name}", re.IGNORECASE | re.ASCII).search(self.source, at)
                    at = close.start() if close else len(self.source)
        self.text(at, len(self.source))
        self.flush()
        return self.found


def blocks_of(source: str | None) -> list[tuple]:
    """The blocks of a page's markup; none for null."""
    return _Page(source).blocks() if source else []


class _Blocks:
    def eval(self, pages: pa.RecordBatch) -> Iterator[pa.Table]:
        rows = [(page, k, *b) for page, source in zip(pages.column("page_id").to_pylist(), pages.column("html").to_pylist()) for k, b in enumerate(blocks_of(source))]
        columns = list(zip(*rows)) or [()] * len(_KINDS)
        yield pa.table({n: pa.array(c, k) for (n, k), c in zip(_KINDS.items(), columns)})


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
_KINDS = {f.split()[0]: _ARROW[f.split()[1]] for f in OUT.split(", ")}


def page_blocks(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row for each block of text of each page: page_id, block (from 0, in
    order), tag of the innermost open block element ("page" outside any), text,
    n_words, n_chars (without blanks), link_chars of them inside links, n_links,
    link_share, density (characters of text for each of the markup from the
    first to the last of them, 1 at most), begin (offset in the page) and place
    (begin as a share of the page).

    Null and empty pages, and pages of markup alone, have no rows.  Pages of one
    id, or without one, each give their blocks.  Other columns are ignored.
    Pages are read where they are stored, without a shuffle; a task holds the
    blocks of one Arrow batch.
    """
    ship_package(pages.sparkSession)
    function = F.arrow_udtf(_Blocks, returnType=OUT)
    return function(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).asTable())
