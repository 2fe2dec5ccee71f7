"""HTML answers → Markdown.

HTML isn't regular, so this is the one conversion done in Python (Arrow batches). Rules: paragraphs, divisions
and breaks start a line, headings 1 to 4 become ``## ``, list items ``- ``, strong/em/code their markers; text
runs are stripped and put together without a separator; runs that are only ``text`` or ``label`` are dropped;
an unfinished entity at the end is lost, since the parser is never closed.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPEN = {"p": "\n", "div": "\n", "br": "\n", "li": "\n- ", "strong": "**", "em": "*", "code": "`"} | dict.fromkeys(("h1", "h2", "h3", "h4"), "\n## ")
_CLOSE = {"strong": "**", "em": "*", "code": "`", "p": "\n", "ul": "\n", "ol": "\n"}
_NOISE = frozenset(("text", "label", "['text', 'label']", '["text", "label"]'))


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.out.append(_OPEN.get(tag, ""))

    def handle_endtag(self, tag: str) -> None:
        self.out.append(_CLOSE.get(tag, ""))

    def handle_data(self, data: str) -> None:
        run = data.strip()
        self.out.append("" if run.lower() in _NOISE else run)


def markdown_of(html: str) -> str:
    reader = _Reader()
    reader.feed(html)
    return "".join(reader.out).strip()


@F.pandas_udf(T.StringType())
def html_to_markdown(html: pd.Series) -> pd.Series:
    """Markdown of each HTML text; NULL stays NULL."""
    return html.map(lambda h: None if h is None else markdown_of(h))
