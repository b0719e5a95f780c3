"""Registered queries over fetched pages: links, metadata blocks, assembly and incremental ingest (S-10 to S-16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.elements import Element, elements, visible_markup
from ..functions.html import MARKUP, unescape_sql
from ..operators import page_metadata as M
from ..session import read_table
from ..sources import ingest
from .registry import register

# `pages` keep their links in <nav><ul><li><a>; the extractions read them there
MENU = (Element("nav"), Element("ul"))
A, LI, H1, NAV = Element("a"), Element("li"), Element("h1"), Element("nav")


def _text_sql(expr: str) -> str:
    return unescape_sql(f"regexp_replace({expr}, '{MARKUP.replace(chr(39), chr(39) * 2)}', '', 'g')")


_ITEMS = f"""
menu AS (SELECT page_id, regexp_extract(html, '(?s)<nav><ul>(.*?)</ul></nav>', 1) AS menu, {_text_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS title FROM pages),
items AS (
  SELECT page_id, pos, title, trim({_text_sql('item')}) AS label, {unescape_sql("regexp_extract(item, 'href=\"([^\"]*)\"', 1)")} AS href
  FROM (SELECT page_id, title, unnest(regexp_extract_all(menu, '(?s)<li>(.*?)</li>', 1)) AS item, generate_subscripts(regexp_extract_all(menu, '<li>'), 1) - 1 AS pos FROM menu))"""


@register("result_links", f"""
WITH {_ITEMS}
SELECT page_id, pos::INT AS position, 'https://example.org/' || substr(href, 2) AS link FROM items""")
def q_result_links(spark, sf_dir):
    return M.extract_result_links(read_table(spark, sf_dir, "pages"), block=LI, link=A, base_url="https://example.org", skip=1, warning=None)


@register("link_count_check", f"""
WITH {_ITEMS}, found AS (SELECT page_id, count(*) AS found FROM items GROUP BY page_id),
declared AS (SELECT page_id, len(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>', '', 'g'), '<a\\b'))::BIGINT AS declared FROM pages)
SELECT page_id, declared, coalesce(found, 0)::BIGINT AS found, declared = coalesce(found, 0) AS ok FROM declared LEFT JOIN found USING (page_id)""")
def q_link_count_check(spark, sf_dir):
    """All anchors of a page against those of its menu; rows that fail are kept, marked."""
    p = read_table(spark, sf_dir, "pages")
    links = M.result_links(F.col("html"), block=LI, link=A, skip=1, warning=None)
    return p.select("page_id", M.link_count_check(F.size(elements(visible_markup(F.col("html")), A)), links).alias("c")).select("page_id", "c.*")


def _menu_dates(html):
    return M.dates_metadata(html, path=MENU, key=LI, value=A, cut=".", value_attribute="href")


def _menu_misc(html):
    return M.misc_metadata(html, path=(), key=H1, value=NAV, part=A)


def _menu_classes(html):
    return M.classification_metadata(html, path=(), key=H1, value=NAV, item=LI, part=A)


_DATES = f"""
{_ITEMS},
numbered AS (SELECT *, replace(label, ':', '') AS k, row_number() OVER (PARTITION BY page_id, replace(label, ':', '') ORDER BY pos) - 1 AS n FROM items),
dates AS (
  SELECT page_id, CASE WHEN n > 0 THEN k || ' ' || n ELSE k END AS key, split_part(href, '.', 1) AS value, pos FROM numbered
  QUALIFY row_number() OVER (PARTITION BY page_id, CASE WHEN n > 0 THEN k || ' ' || n ELSE k END ORDER BY pos DESC) = 1)"""


@register("dates_metadata", f"""
WITH {_DATES}
SELECT page_id, key, value FROM dates""")
def q_dates_metadata(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", F.explode(_menu_dates(F.col("html"))))


@register("misc_metadata", f"""
WITH {_ITEMS}
SELECT page_id, replace(trim(title), ':', '') AS key, string_agg(label, ', ' ORDER BY pos) AS value FROM items GROUP BY page_id, title""")
def q_misc_metadata(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", F.explode(_menu_misc(F.col("html"))))


@register("classification_metadata", f"""
WITH {_ITEMS}
SELECT page_id, replace(trim(title), ':', '') AS key, pos::INT AS position, label FROM items""")
def q_classification_metadata(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    lists = p.select("page_id", F.explode(_menu_classes(F.col("html"))["lists"]))
    return lists.select("page_id", "key", F.posexplode("value").alias("position", "label"))


@register("assemble_documents", f"""
WITH {_DATES},
info AS (SELECT page_id // 2 AS celex_id, min(page_id) AS page_id FROM pages GROUP BY page_id // 2),
texts AS (SELECT doc_id // 3 AS celex_id, arg_max(text, doc_id) AS html FROM documents GROUP BY doc_id // 3)
SELECT celex_id, (SELECT count(*) FROM dates d WHERE d.page_id = i.page_id)::BIGINT AS n_dates,
       (SELECT string_agg(label, ', ' ORDER BY pos) FROM items m WHERE m.page_id = i.page_id) AS misc, md5(html) AS html_md5
FROM info i LEFT JOIN texts USING (celex_id)""")
def q_assemble_documents(spark, sf_dir):
    """Pages describe, documents hold the texts; both kinds repeat ids, and each has some that the other lacks."""
    info = read_table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 2).alias("celex_id"), F.col("page_id").alias("position"), "html")
    text = read_table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 3).alias("celex_id"), (-F.col("doc_id")).alias("position"), F.col("text").alias("html"))
    docs = M.assemble_documents(info, text, dates=_menu_dates, misc=_menu_misc, classification=_menu_classes)
    return docs.select("celex_id", F.size("Dates").cast("long").alias("n_dates"), F.get(F.map_values("Misc"), 0).alias("misc"), F.md5("html").alias("html_md5"))


@register("incremental_ingest", f"""
WITH {_DATES},
existing AS (SELECT doc_id::VARCHAR AS celex_id, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS n_dates, text AS html FROM documents),
fetched AS (
  SELECT (page_id // 2)::VARCHAR AS celex_id, page_id AS position, CASE WHEN contains(url, '?') THEN '' ELSE html END AS html,
         CASE WHEN contains(url, '/fr/') THEN 0 ELSE (SELECT count(*) FROM dates d WHERE d.page_id = p.page_id) END AS n_dates FROM pages p),
open AS (SELECT *, html <> '' AND n_dates > 0 AS good FROM fetched WHERE celex_id NOT IN (SELECT celex_id FROM existing WHERE n_dates > 0)),
pick AS (
  SELECT celex_id, coalesce(arg_min(position, position) FILTER (WHERE good), arg_max(position, position) FILTER (WHERE html <> '')) AS position FROM open GROUP BY celex_id),
new AS (SELECT o.* FROM open o JOIN pick USING (celex_id, position))
SELECT celex_id, n_dates::INT AS n_dates, md5(html) AS html_md5 FROM existing WHERE celex_id NOT IN (SELECT celex_id FROM new)
UNION ALL SELECT celex_id, n_dates::INT, md5(html) FROM new""")
def q_incremental_ingest(spark, sf_dir):
    """Fetched pages into a table of documents: complete documents stay, incomplete ones are replaced, pages without a text are passed over."""
    none = F.create_map().cast("map<string,string>")
    has = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("celex_id"), F.when(F.col("n_chars") > 1000, F.create_map(F.lit("n"), F.col("n_chars").cast("string"))).otherwise(none).alias("Dates"),
        none.alias("Misc"), none.alias("Classification"), F.col("text").alias("html"))
    fetched = read_table(spark, sf_dir, "pages").select(
        F.floor(F.col("page_id") / 2).cast("string").alias("celex_id"), F.col("page_id").alias("position"),
        F.when(~F.col("url").contains("/fr/"), _menu_dates(F.col("html"))).otherwise(none).alias("Dates"), none.alias("Misc"), none.alias("Classification"),
        F.when(F.col("url").contains("?"), F.lit("")).otherwise(F.col("html")).alias("html"))
    return ingest.upsert(has, fetched).select("celex_id", F.size("Dates").alias("n_dates"), F.md5("html").alias("html_md5"))
