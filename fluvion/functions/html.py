"""HTML to Markdown, by the standard library's parser over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

_SKIPPED = {"script", "style", "head", "noscript", "template"}
_BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "nav", "ul", "ol", "table", "tr", "blockquote", "pre", "form", "aside"}


class _Writer(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skipped: list[str] = []
        self.lists: list[int] = []
        self.links: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.skipped.append(tag)
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else -1)
            self.out.append("\n")
        elif tag == "li":
            if self.lists and self.lists[-1] >= 0:
                self.lists[-1] += 1
            self.out.append("\n" + "  " * max(len(self.lists) - 1, 0) + (f"{self.lists[-1]}. " if self.lists and self.lists[-1] > 0 else "- "))
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "code":
            self.out.append("`")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag in ("td", "th"):
            self.out.append(" | ")
        elif tag in _BLOCKS:
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            if tag in self.skipped:
                self.skipped.remove(tag)
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.out.append("\n")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "code":
            self.out.append("`")
        elif tag == "a":
            self.out.append(f"]({self.links.pop()})" if self.links else "]")
        elif tag in _BLOCKS or re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skipped:
            self.out.append(re.sub(r"\s+", " ", data))


def markdown(html: str | None) -> str | None:
    """Null stays null; markup that isn't closed is taken as far as it goes."""
    if html is None:
        return None
    writer = _Writer()
    writer.feed(html)
    writer.close()
    lines = [line.strip() if not re.match(r" +(-|\d+\.) ", line) else line.rstrip() for line in "".join(writer.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def to_markdown(df: DataFrame, id_col: str, html_col: str, out_col: str = "markdown") -> DataFrame:
    """id_col and the Markdown of html_col, one row for each row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([markdown(x) for x in b.column(1).to_pylist()], pa.string())], [id_col, out_col])

    return df.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, `{out_col}` string")
