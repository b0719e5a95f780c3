"""Registered text queries: URL/id helpers, link table, HTML to text, dates, enrichment (P-*, S-09)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import footnotes
from ..functions import text as T
from ..functions.html import MARKUP, html_to_text, html_to_text_sql, unescape_sql
from ..operators.header_split import html_header_split
from ..operators.links import build_link_table
from ..session import read_table
from .registry import register

PY_SPACE = T.PY_SPACE


@register("page_url_helpers", """
SELECT page_id, url AS link,
       split_part(replace(url, 'AUTO', 'EN/ALL'), '&', 1) AS info_page_url,
       split_part(replace(url, 'AUTO', 'EN/TXT/HTML'), '&', 1) AS html_page_url,
       string_split(url, ':')[-1] AS celex_id,
       'https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:' || string_split(url, ':')[-1] AS citation_link
FROM pages""")
def q_page_url_helpers(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    u = F.col("url")
    return p.select("page_id", u.alias("link"), T.info_page_url(u).alias("info_page_url"),
                    T.html_page_url(u).alias("html_page_url"), T.celex_id(u).alias("celex_id"),
                    T.citation_link(T.celex_id(u)).alias("citation_link"))


@register("link_table", """
WITH l AS (
  SELECT page_id, url AS link,
         split_part(replace(url, 'AUTO', 'EN/ALL'), '&', 1) AS info_page_url,
         split_part(replace(url, 'AUTO', 'EN/TXT/HTML'), '&', 1) AS html_page_url
  FROM pages)
SELECT info_page_url, arg_min(link, page_id) AS link, arg_min(html_page_url, page_id) AS html_page_url,
       string_split(info_page_url, ':')[-1] AS celex_id, min(page_id) AS first_position
FROM l GROUP BY info_page_url""")
def q_link_table(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    return build_link_table(p, link_col="url", position_col="page_id")


@register("html_to_text", f"""
SELECT page_id, {html_to_text_sql('html')} AS text FROM pages""")
def q_html_to_text(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", html_to_text(F.col("html")).alias("text"))


@register("collapse_blank_lines", f"""
SELECT doc_id, regexp_replace(text, '(\\n{PY_SPACE}*\\n)+', chr(10), 'g') AS text FROM documents""")
def q_collapse_blank_lines(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", T.collapse_blank_lines(F.col("text")).alias("text"))


@register("collapse_newlines", """
SELECT conv_id, turn, regexp_replace(text, '\\n+', chr(10), 'g') AS text FROM conversations""")
def q_collapse_newlines(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.collapse_newlines(F.col("text")).alias("text"))


@register("nested_value", """
SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k,
       coalesce(json_extract_string(props, '$.missing.key'), '') AS missing
FROM events""")
def q_nested_value(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    return e.select("event_id", T.json_value(F.col("props"), ["k"]).alias("k"),
                    T.json_value(F.col("props"), ["missing", "key"]).alias("missing"))


@register("reformat_date", """
WITH s AS (SELECT event_id, strftime(ts, '%d/%m/%Y') AS raw FROM events)
SELECT event_id, raw, coalesce(array_to_string(list_reverse(string_split(raw, '/')), '-'), '') AS date,
       try_strptime(array_to_string(list_reverse(string_split(raw, '/')), '-'), '%Y-%m-%d')::DATE AS date_typed
FROM s""")
def q_reformat_date(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "dd/MM/yyyy").alias("raw"))
    return e.select("event_id", "raw", T.reformat_date(F.col("raw")).alias("date"),
                    T.typed_date(F.col("raw")).alias("date_typed"))


@register("enrich_text", """
SELECT doc_id, 'Document content:' || chr(10) || text
       || coalesce(chr(10) || 'lang:' || lang, '')
       || coalesce(chr(10) || 'source:' || source, '')
       || coalesce(chr(10) || 'n_chars:' || CAST(n_chars AS VARCHAR), '') AS text
FROM documents""")
def q_enrich_text(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", T.enrich_text(F.col("text"), [("lang", F.col("lang")), ("source", F.col("source")),
                                                             ("n_chars", F.col("n_chars"))]).alias("text"))


@register("drop_not_found", """
SELECT page_id, url FROM pages WHERE NOT coalesce(contains(html, 'The requested document does not exist.'), false)""")
def q_drop_not_found(spark, sf_dir):
    return T.drop_not_found(read_table(spark, sf_dir, "pages")).select("page_id", "url")


@register("text_only_share", """
SELECT count(*) AS n_pages,
       count(*) FILTER (WHERE coalesce(regexp_matches(html, '<div[^>]*id=["'']TexteOnly'), false)) AS n_text_only,
       round(100.0 * avg(CASE WHEN coalesce(regexp_matches(html, '<div[^>]*id=["'']TexteOnly'), false)
                              THEN 1.0 ELSE 0.0 END), 6) AS pct_text_only
FROM pages""")
def q_text_only_share(spark, sf_dir):
    return T.text_only_share(read_table(spark, sf_dir, "pages"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_NOTE_TEXT = (f"regexp_replace(replace(array_to_string(list_transform(list_filter(string_split_regex(n, {_quoted(MARKUP)}), lambda s: s <> ''), "
              f"lambda s: regexp_replace({unescape_sql('s')}, {_quoted(footnotes.EDGE_SPACE)}, '', 'g')), ''), chr(160), ' '), {_quoted(footnotes.NUMBER)}, '')")


@register("resolve_footnotes", f"""
WITH cut AS (
  SELECT page_id, regexp_replace(html, {_quoted(footnotes.NOTE)}, '', 'g') AS body,
         list_filter(list_transform(regexp_extract_all(html, {_quoted(footnotes.NOTE)}), lambda n: {{'id': regexp_extract(
           regexp_extract(n, {_quoted(footnotes.FIRST_LINK)}), {_quoted(footnotes.ID)}, 1), 'text': {_NOTE_TEXT}}}), lambda x: x.id <> '') AS known FROM pages),
parts AS (
  SELECT page_id, known, string_split_regex(body, {_quoted(footnotes.REFERENCE)}) AS pieces,
         regexp_extract_all(body, {_quoted(footnotes.REFERENCE)}) AS refs FROM cut)
SELECT page_id, array_to_string(list_transform(range(1, len(pieces) + 1), lambda i: pieces[i] || coalesce(
         '(' || replace(replace(replace(list_filter(known, lambda x: x.id = regexp_extract(refs[i], {_quoted(footnotes.TARGET)}, 1))[-1].text,
                                        '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || ')', refs[i], '')), '') AS html
FROM parts""")
def q_resolve_footnotes(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", footnotes.resolve_footnotes(F.col("html")).alias("html"))


def _line(sql: str) -> str:
    return f"trim(regexp_replace({sql}, '{PY_SPACE}+', ' ', 'g'))"


@register("html_header_split", f"""
WITH cut AS (
  SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?is)<(?:h1|h2)\\b[^>]*>.*?</(?:h1|h2)\\s*>') AS hs,
         string_split_regex(coalesce(html, ''), '(?is)<(?:h1|h2)\\b[^>]*>.*?</(?:h1|h2)\\s*>') AS bodies FROM pages),
pieces AS (
  SELECT page_id, unnest(range(len(bodies))) AS pos, unnest(bodies) AS html, unnest([NULL] || hs) AS header FROM cut),
named AS (
  SELECT page_id, pos, {_line(html_to_text_sql('html'))} AS html, lower(header[2:3]) AS tag,
         {_line(html_to_text_sql('header'))} AS title FROM pieces),
paths AS (
  SELECT page_id, pos, html,
         last_value(CASE WHEN tag = 'h1' THEN title END IGNORE NULLS) OVER w AS title1,
         last_value(CASE WHEN tag = 'h2' THEN title END IGNORE NULLS) OVER w AS title2,
         coalesce(max(CASE WHEN tag = 'h2' THEN pos END) OVER w > coalesce(max(CASE WHEN tag = 'h1' THEN pos END) OVER w, -1), false) AS under
  FROM named WINDOW w AS (PARTITION BY page_id ORDER BY pos))
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1)::INT AS chunk_index, html,
       title1 AS "HTMLSplitter_Header 1", CASE WHEN under THEN title2 END AS "HTMLSplitter_Header 2"
FROM paths WHERE html <> ''""")
def q_html_header_split(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages").select("page_id", "html")
    return html_header_split(p, [("h1", "Header 1"), ("h2", "Header 2")], "html")
