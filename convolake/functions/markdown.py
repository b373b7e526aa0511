"""Markdown of vendors made regular: lines inside and outside code fences, blank lines, marks that stand for links. All in Spark's own functions.

A text is parted at its fence lines, so that its stretches are outside and inside of a fence by turns; an open fence reaches to the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of no width; spaces that are made plain; what ends a line. Fixed values.
NO_WIDTH = r"[​‌‍⁠﻿]"
SPACES = r"[  ]"
LINE_ENDS = r"\r\n|[\r\u000b\u000c\u001c-\u001e\u0085  ]"
#: Marks of one vendor's payloads: citations, generated files, images that were never resolved, fences with a query. Fixed values.
CITE, FILE_TAG, MADE_IMAGE = r"\[cite:\s*\d+\]", r"\[file-tag:\s*[^\]]+\]", r"https?://googleusercontent\.com/image_generation_content/\S+"
FENCE_QUERY = r"(?m)^```([^\n`?]*)\?[^\n`]*$"
#: Inline citations of another vendor, and the number in them. Fixed values.
RENDER, CITATION_ID = r"(?is)<grok:render\b[^>]*>.*?</grok:render>", r"(?is)<argument\b[^>]*name=[\"']citation_id[\"'][^>]*>(.*?)</argument>"


def _outside_and_inside(c: Column, fence: str, outside, inside, line=None) -> Column:
    """c with outside(stretch, whether it is the last) and inside(stretch) in place of its stretches, and line(fence line)."""
    stretches, fences = F.split(c, fence, -1), F.regexp_extract_all(c, F.lit(fence), F.lit(0))
    done = F.transform(stretches, lambda s, i: F.when(i % 2 == 0, outside(s, i == F.size(stretches) - 1)).otherwise(inside(s)))
    ends = F.transform(fences, line) if line else fences
    return F.array_join(F.flatten(F.zip_with(done, ends, lambda s, f: F.array(s, F.coalesce(f, F.lit(""))))), "")


def normalise_text(c: Column) -> Column:
    """Spaces of any kind as one outside of fences and no blanks at the ends of lines; inside, lines keep how they begin. At most one blank line in a row."""
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), SPACES, " "), NO_WIDTH, ""), LINE_ENDS, "\n")
    end = lambda s: F.regexp_replace(s, r"(?Udm)[^\S\n]+$", "")
    out = lambda s, last: F.regexp_replace(F.regexp_replace(s, "[ \t]+", " "), r"(?Udm)^[^\S\n]+|[^\S\n]+$", "")
    made = _outside_and_inside(c, r"(?Udm)^[^\S\n]*```[^\n]*$", out, end, end)
    return F.regexp_replace(F.regexp_replace(made, "\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def tidy_blank_lines(c: Column) -> Column:
    """Outside of fences one blank line, the first, for each run of them."""
    first = lambda s: F.regexp_replace(s, r"(\n[^\S\n]*)(?:\n[^\S\n]*)+(?=\n)", "$1")
    final = lambda s: F.regexp_replace(s, r"(\n[^\S\n]*)(?:\n[^\S\n]*)+(?=\n|\z)", "$1")
    made = _outside_and_inside(F.concat(F.lit("\n"), c), r"(?dm)^```[^\n]*$", lambda s, last: F.when(last, final(s)).otherwise(first(s)), lambda s: s)
    return F.substring(made, 2, 1 << 30)


def trim_fences(c: Column) -> Column:
    """Code without blank lines at its end; a fence of nothing else stays."""
    block = r"(?dms)^```[^\n`]*\n.*?^```[ \t]*$"
    trimmed = lambda x: F.when(x.rlike(r"(?Uds)\A```[^\n`]*\n\s*```[ \t]*\z"), x).otherwise(F.regexp_replace(x, r"(?Uds)\s+```[ \t]*\z", "\n```"))
    stretches, blocks = F.split(c, block, -1), F.transform(F.regexp_extract_all(c, F.lit(block), F.lit(0)), trimmed)
    return F.array_join(F.flatten(F.zip_with(stretches, blocks, lambda s, x: F.array(s, F.coalesce(x, F.lit(""))))), "")


def normalise_markdown(c: Column, marks: Column | None = None) -> Column:
    """One vendor's Markdown in the common form. marks: a map from marks (file tags, addresses of generated images) to the links that they stand for."""
    c = F.coalesce(c, F.lit(""))
    if marks is not None:
        c = F.aggregate(F.map_entries(F.coalesce(marks, F.create_map().cast("map<string,string>"))), c, lambda t, e: F.replace(t, e["key"], e["value"]))
    for pattern in (MADE_IMAGE, FILE_TAG, CITE):
        c = F.regexp_replace(c, pattern, "")
    c = trim_fences(F.regexp_replace(c, FENCE_QUERY, "```$1"))
    c = tidy_blank_lines(F.regexp_replace(c, r"(?m)^(\s*)[*+] ", "$1- "))
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def escape_label(c: Column) -> Column:
    """Text of a link: brackets escaped, on one line."""
    return F.replace(F.replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))


def escape_href(c: Column) -> Column:
    """Address of a link: parentheses encoded."""
    return F.replace(F.replace(c, F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))


def render_citations(c: Column, urls: Column) -> Column:
    """Inline citations as links, by a map from card to address; those of an unknown card stay."""

    def link(tag: Column) -> Column:
        card = F.regexp_extract(tag, r"(?is)^<grok:render\b[^>]*?\bcard_id=[\"']([^\"']*)[\"']", 1)
        number = F.trim(F.regexp_extract(tag, CITATION_ID, 1))
        label = F.when(tag.rlike(CITATION_ID), number).otherwise("source")
        return F.concat(F.lit("["), escape_label(label), F.lit("]("), F.element_at(urls, card), F.lit(")"))

    tags = F.array_distinct(F.regexp_extract_all(c, F.lit(RENDER), F.lit(0)))
    return F.aggregate(tags, c, lambda t, tag: F.coalesce(F.replace(t, tag, link(tag)), t))
