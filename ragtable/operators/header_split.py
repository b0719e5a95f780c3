"""HTML header split (C-08): one row per piece of text under a path of headers.

The page is cut at its header elements, and a fold over the headers carries the
current header of every level: a header sets its own level and clears the lower
ones. All of it happens on the page's row, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import html_to_text
from ..functions.text import PY_SPACE


def _pattern(tags: Sequence[str]) -> str:
    return rf"(?is)<(?:{'|'.join(tags)})\b[^>]*>.*?</(?:{'|'.join(tags)})\s*>"


def _one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{PY_SPACE}+", " "))


def _paths(headers: Column, tags: Sequence[str]) -> Column:
    """Array of header paths: the empty path before the first header, then one after each header."""
    none = F.array(*[F.lit(None).cast("string") for _ in tags])
    level = {t: i for i, t in enumerate(tags)}

    def step(acc: Column, header: Column) -> Column:
        tag = F.lower(F.regexp_extract(header, r"(?i)^<([a-z0-9]+)", 1))
        at = F.coalesce(*[F.when(tag == t, F.lit(i)) for t, i in level.items()])
        title = _one_line(html_to_text(header))
        path = F.transform(acc["path"], lambda x, i: F.when(i < at, x).when(i == at, title))
        return F.struct(path.alias("path"), F.concat(acc["all"], F.array(path)).alias("all"))

    return F.aggregate(headers, F.struct(none.alias("path"), F.array(none).alias("all")), step, lambda acc: acc["all"])


def html_header_split(df: DataFrame, headers: Sequence[tuple[str, str]], field: str, prefix: str = "HTMLSplitter_") -> DataFrame:
    """C-08: ``headers`` are (tag, name), highest level first; each row of ``df`` gives one row per piece with text.

    ``field`` becomes the piece's text on one line, ``chunk_index`` counts a page's pieces from 0, and ``<prefix><name>`` holds
    the header in force, null where there is none. Null or empty html gives no rows; other columns are copied.
    """
    tags = [t.lower() for t, _ in headers]
    html = F.coalesce(F.col(field), F.lit(""))
    pieces = F.zip_with(_paths(F.regexp_extract_all(html, F.lit(_pattern(tags)), 0), tags), F.split(html, _pattern(tags)),
                        lambda path, body: F.struct(path.alias("path"), _one_line(html_to_text(body)).alias("text")))
    out = df.withColumn("_pieces", F.filter(pieces, lambda p: p["text"] != ""))
    out = out.select(*[c for c in df.columns if c != field], F.posexplode("_pieces").alias("chunk_index", "_piece"))
    return out.select(*[c for c in df.columns if c != field], "chunk_index", F.col("_piece.text").alias(field),
                      *[F.col("_piece.path")[i].alias(prefix + name) for i, (_, name) in enumerate(headers)])
