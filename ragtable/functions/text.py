"""Scalar text functions as Spark column expressions (P-01..P-04, P-06, P-06b, P-08, P-10..P-13).

Every function maps Column -> Column and stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values (must equal the source data's conventions).
CITATION_PREFIX = "https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:"
NOT_FOUND_MARKER = "The requested document does not exist."
TEXT_ONLY_PATTERN = "<div[^>]*id=[\"']TexteOnly"

# Python's str.isspace() set, written so Java regex and RE2 read it the same way.
PY_SPACE = r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _url_rewrite(c: Column, target: str) -> Column:
    return F.substring_index(F.replace(c, F.lit("AUTO"), F.lit(target)), "&", 1)


def info_page_url(c: Column) -> Column:
    """P-01: 'AUTO' -> 'EN/ALL', cut at the first '&'."""
    return _url_rewrite(c, "EN/ALL")


def html_page_url(c: Column) -> Column:
    """P-02: 'AUTO' -> 'EN/TXT/HTML', cut at the first '&'."""
    return _url_rewrite(c, "EN/TXT/HTML")


def celex_id(c: Column) -> Column:
    """P-03: the text after the last ':' (the whole string when there is none)."""
    return F.substring_index(c, ":", -1)


def citation_link(c: Column) -> Column:
    """P-04: constant prefix + id."""
    return F.concat(F.lit(CITATION_PREFIX), c)


def collapse_blank_lines(c: Column) -> Column:
    """P-06: runs of blank lines (whitespace-only lines included) become one newline."""
    return F.regexp_replace(c, f"(\\n{PY_SPACE}*\\n)+", "\n")


def collapse_newlines(c: Column) -> Column:
    """P-06b: runs of newlines become one."""
    return F.regexp_replace(c, "\\n+", "\n")


def nested_value(c: Column, path: Sequence[str], default: str = "") -> Column:
    """P-08: walk a map/struct column along ``path``; missing -> ``default`` ('' by default).

    ``path`` must be a list of keys (a bare string would be walked character by
    character by the source's helper; it is rejected here instead).
    """
    if isinstance(path, str):
        raise TypeError("path must be a list of keys, not a string")
    out = c
    for key in path:
        out = out[key]
    return F.coalesce(out.cast("string"), F.lit(default))


def json_value(c: Column, path: Sequence[str], default: str = "") -> Column:
    """P-08 over JSON text: ``nested_value`` with the document kept as a JSON string."""
    if isinstance(path, str):
        raise TypeError("path must be a list of keys, not a string")
    jp = "$" + "".join(f".{k}" for k in path)
    return F.coalesce(F.get_json_object(c, jp), F.lit(default))


def reformat_date(c: Column) -> Column:
    """P-10: reverse the '/'-separated parts and join with '-'; null -> ''. No validation."""
    return F.coalesce(F.array_join(F.reverse(F.split(c, "/")), "-"), F.lit(""))


def typed_date(c: Column) -> Column:
    """P-10 second column: the reformatted string as a DATE, NULL when it is not a real date."""
    return F.try_to_date(reformat_date(c), "yyyy-MM-dd")


def enrich_text(text: Column, metadata: Sequence[tuple[str, Column]]) -> Column:
    """P-11: 'Document content:\\n' + text, then '\\n<key>:<value>' per present value.

    ``metadata`` pairs the last key of each dotted path with its value column;
    array values are joined with ','; null (missing) values are skipped.
    """
    parts = [F.lit("Document content:\n"), F.coalesce(text.cast("string"), F.lit(""))]
    for key, val in metadata:
        parts.append(F.coalesce(F.concat(F.lit(f"\n{key}:"), val.cast("string")), F.lit("")))
    return F.concat(*parts)


def enrich_list(key: str, arr: Column) -> tuple[str, Column]:
    """A list-valued metadata entry for ``enrich_text``: items joined with ','."""
    return key, F.array_join(F.transform(arr, lambda x: x.cast("string")), ",")


def is_not_found(html: Column) -> Column:
    """P-12 predicate: page carries the 'document does not exist' notice."""
    return F.coalesce(F.contains(html, F.lit(NOT_FOUND_MARKER)), F.lit(False))


def drop_not_found(df: DataFrame, html_col: str = "html") -> DataFrame:
    """P-12: keep pages that are not 'document does not exist' notices."""
    return df.filter(~is_not_found(F.col(html_col)))


def text_only_share(df: DataFrame, html_col: str = "html") -> DataFrame:
    """P-13: count and percentage of pages with a ``div#TexteOnly`` block (one row)."""
    flag = F.coalesce(F.col(html_col).rlike(TEXT_ONLY_PATTERN), F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count_if(flag).alias("n_text_only"),
        F.round(100.0 * F.avg(flag.cast("double")), 6).alias("pct_text_only"),
    )
