"""Footnote inlining as column expressions (P-07).

A page holds both its footnotes (``<p class="oj-note">`` with an ``<a id=...>``) and the
references to them (``<a href="#id">``), so a reference is resolved on the page's own row:
no join, no shuffle. The notes are cut out, the rest is split at the references, and each
reference to a known note becomes the note's text in brackets. Other links stay as they are.
Of notes that share an id the last one counts; null html stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import text_nodes, unescape_entities
from .text import PY_SPACE
from .tokens import let

# The markup of footnotes and of references to them.
NOTE = r"""(?is)<p\b[^>]*\bclass\s*=\s*["'](?:[^"'>]*\s)?oj-note(?:\s[^"'>]*)?["'][^>]*>.*?</p\s*>"""
REFERENCE = r"""(?is)<a\b[^>]*\bhref\s*=\s*["']#[^"'>]*["'][^>]*>.*?</a\s*>"""
FIRST_LINK = r"(?is)<a\b[^>]*>"
ID = r"""(?is)\sid\s*=\s*["']([^"'>]*)["']"""
TARGET = r"""(?is)\shref\s*=\s*["']#([^"'>]*)["']"""
NUMBER = r"^\(\d+\)"
EDGE_SPACE = f"^{PY_SPACE}+|{PY_SPACE}+$"


def _escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def note_text(note: Column) -> Column:
    """Text of one note without its number: stripped text nodes in a row, no-break spaces as spaces."""
    nodes = F.transform(text_nodes(note), lambda s: F.regexp_replace(unescape_entities(s), EDGE_SPACE, ""))
    return F.regexp_replace(F.replace(F.array_join(nodes, ""), F.lit("\u00a0"), F.lit(" ")), NUMBER, "")


def notes(html: Column) -> Column:
    """Array of (id, text) of the page's notes that carry a link with an id."""
    found = F.transform(F.regexp_extract_all(html, F.lit(NOTE), 0), lambda n: F.struct(
        F.regexp_extract(F.regexp_extract(n, FIRST_LINK, 0), ID, 1).alias("id"), note_text(n).alias("text")))
    return F.filter(found, lambda n: n["id"] != "")


def resolve_footnotes(html: Column) -> Column:
    """P-07: references replaced by '(note text)', notes removed."""

    def assemble(body: Column, known: Column) -> Column:
        def put(piece: Column, ref: Column) -> Column:
            target = F.regexp_extract(ref, TARGET, 1)
            hit = F.try_element_at(F.filter(known, lambda n: n["id"] == target), F.lit(-1))
            text = F.when(hit.isNull(), ref).otherwise(F.concat(F.lit("("), _escape(hit["text"]), F.lit(")")))
            return F.concat(piece, F.coalesce(text, F.lit("")))

        return F.array_join(F.zip_with(F.split(body, REFERENCE), F.regexp_extract_all(body, F.lit(REFERENCE), 0), put), "")

    return let(F.regexp_replace(html, NOTE, ""), lambda body: let(notes(html), lambda known: assemble(body, known)))
