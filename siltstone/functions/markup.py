"""Markup by its structure: character references of every kind, and the text of article XML."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The parts of an article that hold its text, those that go, those whose end ends a paragraph.
JATS_KEPT = ("abstract", "body")
JATS_DROPPED = ("ref-list", "back", "xref", "table-wrap", "fig", "disp-formula", "inline-formula")
JATS_BLOCKS = ("p", "sec", "title", "abstract")
_PIECE = re.compile(r"<!--.*?-->|<!\[CDATA\[(.*?)\]\]>|<\?.*?\?>|<(/?)([A-Za-z_][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*?)(/?)>", re.S)


# What html.unescape() takes for one reference.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.pandas_udf(ArrayType(StringType()))
def _unescaped(references: pd.Series) -> pd.Series:
    return references.map(lambda found: [html.unescape(x) for x in found], na_action="ignore")


def unescape(text: Column) -> Column:
    """All character references, named and numeric; only they go through Python, not the text around them."""
    found = _unescaped(F.when(F.contains(text, F.lit("&")), F.regexp_extract_all(text, F.lit(REFERENCE), 0)))
    parts = F.split(text, REFERENCE, -1)
    return F.coalesce(F.array_join(F.flatten(F.zip_with(parts, found, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), ""), text)


def _matched(pieces: list[re.Match], names: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    """The outermost elements of these names, as (opening, closing) pieces; an element without its end is none."""
    open_tags: list[tuple[str, int]] = []
    spans: list[tuple[int, int]] = []
    for i, piece in enumerate(pieces):
        name = (piece[3] or "").lower()
        if name not in names or piece[5]:
            continue
        if not piece[2]:
            open_tags.append((name, i))
            continue
        for k in range(len(open_tags) - 1, -1, -1):
            if open_tags[k][0] == name:
                spans.append((open_tags[k][1], i))
                del open_tags[k:]
                break
    end = -1
    for first, last in sorted(spans):
        if first > end:
            yield first, last
            end = last


def article_text(raw: str) -> str:
    """The text of abstract and body (of everything, where there is neither), without references, tables, figures and
    formulas, nested ones too; ended blocks end paragraphs.  Markup that is not closed is read as if it were not there."""
    pieces = list(_PIECE.finditer(raw))
    dropped = dict(_matched(pieces, JATS_DROPPED))
    kept = list(_matched(pieces, JATS_KEPT)) or [(-1, len(pieces))]
    parts = []
    for first, last in kept:
        out, i = [], first
        at = pieces[first].end() if first >= 0 else 0
        while (i := i + 1) <= last:
            end = i == len(pieces)
            out.append(html.unescape(raw[at : len(raw) if end else pieces[i].start()]))
            if end:
                break
            piece = pieces[i]
            out.append(piece[1] if piece[1] is not None else "\n\n" if piece[2] and piece[3].lower() in JATS_BLOCKS else " ")
            i = min(dropped.get(i, i), last)
            at = pieces[i].end()
        parts.append("".join(out))
    return "\n\n".join(parts)


@F.pandas_udf(StringType())
def article(texts: pd.Series) -> pd.Series:
    """article_text() of a column; null stays null."""
    return texts.map(article_text, na_action="ignore")
