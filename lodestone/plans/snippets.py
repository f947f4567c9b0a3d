"""Highlighted snippets of hits."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import MAX_TOKEN, MIN_TOKEN, query_terms


def snippet(text: str | None, terms: list[str], width: int = 250, highlight: bool = True) -> str:
    """The window of at most ``width`` characters with most distinct query terms, the leftmost of equals, as HTML.

    Text is escaped before the marks are added; only whole tokens are marked. Null or empty text gives "".
    """
    if not text:
        return ""
    wanted = set(terms)
    spans = [(m.start(), m.end(), m[0].lower()) for m in re.finditer("[A-Za-z0-9]+", text) if MIN_TOKEN <= m.end() - m.start() <= MAX_TOKEN and m[0].lower() in wanted]
    best, at, j, inside = 0, 0, 0, {}
    for i, (start, _, term) in enumerate(spans):
        while j < len(spans) and spans[j][1] - start <= width:
            inside[spans[j][2]] = inside.get(spans[j][2], 0) + 1
            j += 1
        if len(inside) > best:
            best, at = len(inside), start
        if term in inside:
            inside[term] -= 1
            if not inside[term]:
                del inside[term]
        j = max(j, i + 1)
    start = max(0, min(at, len(text) - width))
    end, out, last = min(len(text), start + width), [], start
    for s, e, _ in spans if highlight else []:
        if s >= start and e <= end:
            out += [html.escape(text[last:s]), f"<b>{html.escape(text[s:e])}</b>"]
            last = e
    return "".join([*out, html.escape(text[last:end])])


def with_snippets(hits: DataFrame, query: str, width: int = 250) -> DataFrame:
    """Hits with text, plus the column ``snippet``; meant for top-k rows."""
    terms = query_terms(query)

    @F.pandas_udf("string")
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda t: snippet(t, terms, width))

    return hits.withColumn("snippet", cut("text"))
