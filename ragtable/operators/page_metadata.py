"""What a fetched legislation page says about itself and its neighbours (S-10 to S-15).

Each extraction takes the container, item and attribute it reads as parameters;
the defaults are the markup of the publisher's result and information pages.
All are expressions on the page's row; only ``assemble_documents`` shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.elements import Element, attribute, elements, following_siblings, inner_of_first, raw_text, stripped_text, visible_markup
from ..functions.text import PY_SPACE
from ..functions.tokens import let

# Where the pages keep their result links, metadata blocks and English texts.
RESULT = Element("div", "class", "SearchResult")
RESULT_LINK = Element("a", "class", "title")
WARNING = Element("div", "class", "alert alert-warning")
WARNING_TEXT = "maximum number of pages"
BLOCK = Element("dl", "class", "NMetadata")
DATES = (Element("div", "id", "PPDates_Contents"), BLOCK)
MISC = (Element("div", "id", "PPMisc_Contents"), BLOCK)
CLASSES = (Element("div", "id", "PPClass_Contents"), BLOCK)
KEY, VALUE, ITEM = Element("dt"), Element("dd"), Element("li")
ENGLISH = Element("span", "lang", "en")
DIRECTORY = "Directory code"
BASE_URL = "https://eur-lex.europa.eu"


def result_links(html: Column, block: Element = RESULT, link: Element = RESULT_LINK, base_url: str = BASE_URL, skip: int = 2, warning: Element | None = WARNING) -> Column:
    """S-10: the links of a result page in order, array<string>.

    Only anchors inside a result block count; ``skip`` leading characters of
    each href go and ``base_url`` comes before. A page that warns of too high a
    page number, and a page without links, give null.
    """

    def found(m):
        anchors = F.flatten(F.transform(elements(m, block), lambda b: elements(b["inner"], link)))
        hrefs = F.filter(F.transform(anchors, lambda a: attribute(a["start_tag"], "href")), lambda h: h.isNotNull())
        links = F.transform(hrefs, lambda h: F.concat(F.lit(base_url + "/"), F.substring(h, skip + 1, 1 << 30)))
        warned = F.lit(False) if warning is None else F.coalesce(raw_text(inner_of_first(m, warning)).contains(WARNING_TEXT), F.lit(False))
        return F.when(~warned & (F.size(links) > 0), links)

    return let(visible_markup(html), found)


def extract_result_links(pages: DataFrame, page_id: str = "page_id", html: str = "html", **markup) -> DataFrame:
    """S-10 as rows: page_id, position (from 0), link; pages without links have no rows."""
    return pages.select(F.col(page_id), F.posexplode(result_links(F.col(html), **markup)).alias("position", "link"))


def result_count(html: Column, tag: str = "strong", nth: int = 3) -> Column:
    """S-11: the number in the ``nth`` of the sibling elements ``tag`` that start with the first one that holds text alone.

    Null where there are fewer or it is no whole number.
    """
    plain = lambda inner: (inner != "") & ~inner.contains("<")

    def nth_sibling(m):
        first = F.get(F.filter(elements(m, Element(tag)), lambda e: plain(e["inner"])), 0)
        from_first = let(F.concat(first["start_tag"], first["inner"]), lambda head: F.substring(m, F.instr(m, head), F.length(m)))
        text = F.get(following_siblings(from_first, tag), nth - 1)
        return F.when(first.isNotNull() & plain(text), F.regexp_replace(raw_text(text), f"^{PY_SPACE}+|{PY_SPACE}+$", "").try_cast("long"))

    return let(visible_markup(html), nth_sibling)


def link_count_check(declared: Column, links: Column) -> Column:
    """S-11: struct<declared, found, ok>: what a page says it lists against what was found there; an undeclared count is not ok."""
    found = F.coalesce(F.size(links), F.lit(0)).cast("long")
    return F.struct(declared.cast("long").alias("declared"), F.greatest(found, F.lit(0).cast("long")).alias("found"),
                    F.coalesce(declared.cast("long") == F.greatest(found, F.lit(0).cast("long")), F.lit(False)).alias("ok"))


def _pairs(markup: Column, path, key: Element, value: Element) -> Column:
    """array<struct<key, start_tag, inner>>: keys and values of the block as they follow each other; a surplus of one of them is left out."""

    def zipped(block):
        keys, values = elements(block, key), elements(block, value)
        both = F.zip_with(keys, values, lambda k, v: F.struct(F.replace(stripped_text(k["inner"]), F.lit(":"), F.lit("")).alias("key"), v["start_tag"].alias("start_tag"), v["inner"].alias("inner"),
                                                              (k.isNotNull() & v.isNotNull()).alias("full")))
        return F.filter(both, lambda p: p["full"])

    none = F.array().cast("array<struct<key:string,start_tag:string,inner:string,full:boolean>>")
    return F.coalesce(let(inner_of_first(markup, *path), zipped), none)


def _numbered(pairs: Column) -> Column:
    """Pairs whose repeated keys carry a number: the second "key" is "key 1", the third "key 2"."""

    def named(ps):
        def one(p, i):
            before = F.size(F.filter(F.slice(ps, 1, i), lambda q: q["key"] == p["key"]))
            return F.struct(F.when(before > 0, F.concat_ws(" ", p["key"], before)).otherwise(p["key"]).alias("key"), p["value"].alias("value"))

        return F.transform(ps, one)

    return let(pairs, named)


def _as_map(entries: Column) -> Column:
    """Map of (key, value) structs in order; of equal keys the last counts."""
    return let(entries, lambda es: F.map_from_entries(F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda later: later["key"] == e["key"]))))


def dates_metadata(html: Column, path=DATES, key: Element = KEY, value: Element = VALUE, cut: str = ";", value_attribute: str | None = None) -> Column:
    """S-12: map<string,string> of the block's pairs, in document order.

    Colons go from keys, repeated keys are numbered, values end before the
    first ``cut``. A page without the block gives an empty map.
    """

    def entry(p):
        text = stripped_text(p["inner"]) if value_attribute is None else F.coalesce(attribute(p["start_tag"], value_attribute), F.lit(""))
        return F.struct(p["key"].alias("key"), F.substring_index(text, cut, 1).alias("value"))

    return _as_map(_numbered(F.transform(_pairs(visible_markup(html), path, key, value), entry)))


def misc_metadata(html: Column, path=MISC, key: Element = KEY, value: Element = VALUE, part: Element = ENGLISH) -> Column:
    """S-13: as ``dates_metadata``; a value is its ``part`` elements' texts joined by ", ", or its whole text if it has none."""

    def entry(p):
        said = let(elements(p["inner"], part), lambda parts: F.when(F.size(parts) > 0, F.array_join(F.transform(parts, lambda s: stripped_text(s["inner"])), ", ")))
        return F.struct(p["key"].alias("key"), F.coalesce(said, stripped_text(p["inner"])).alias("value"))

    return _as_map(_numbered(F.transform(_pairs(visible_markup(html), path, key, value), entry)))


def classification_metadata(html: Column, path=CLASSES, key: Element = KEY, value: Element = VALUE, item: Element = ITEM, part: Element = ENGLISH,
                            directory: str = DIRECTORY) -> Column:
    """S-14: struct<lists map<string,array<string>>, directory map<string,string>>.

    lists has, for every key but ``directory``, the first ``part`` of each item
    that holds one; an item inside an item is an item of its own. directory has
    "code", the first line of its first item, and "level 1", "level 2", ... for
    all parts in order. Of equal keys the last counts; a page without the block
    gives two empty maps.
    """

    def texts(found):
        return F.transform(found, lambda s: stripped_text(s["inner"]))

    def listed(p):
        firsts = F.transform(elements(p["inner"], item), lambda li: F.get(texts(elements(li["inner"], part)), 0))
        return F.struct(p["key"].alias("key"), F.filter(firsts, lambda t: t.isNotNull()).alias("value"))

    def coded(p):
        head = F.regexp_replace(F.substring_index(raw_text(inner_of_first(p["inner"], item)), "\n", 1), f"^{PY_SPACE}+|{PY_SPACE}+$", "")
        levels = F.transform(texts(elements(p["inner"], part)), lambda t, i: F.struct(F.concat_ws(" ", F.lit("level"), i + 1).alias("key"), t.alias("value")))
        code = F.array(F.struct(F.lit("code").alias("key"), head.alias("value")))
        return F.concat(F.filter(code, lambda c: c["value"].isNotNull()), levels)

    def both(pairs):
        lists = F.transform(F.filter(pairs, lambda p: p["key"] != directory), listed)
        codes = F.flatten(F.transform(F.filter(pairs, lambda p: p["key"] == directory), coded))
        return F.struct(_as_map(lists).alias("lists"), _as_map(codes).alias("directory"))

    return let(_pairs(visible_markup(html), path, key, value), both)


def classification_texts(classification: Column) -> Column:
    """S-14's struct as map<string,string>, lists and directory as JSON text: the form in which documents are read."""
    lists = F.transform_values(classification["lists"], lambda _, v: F.to_json(v))
    codes = F.when(F.size(classification["directory"]) > 0, F.create_map(F.lit(DIRECTORY), F.to_json(classification["directory"])))
    return F.map_concat(lists, F.coalesce(codes, F.create_map().cast("map<string,string>")))


def _first_of(pages: DataFrame, key: str, position: str, html: str) -> DataFrame:
    """One row for each id: the page of least position (ties: least html)."""
    return (pages.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("celex_id"))
            .agg(F.min_by(F.struct(F.col(html).alias("html")), F.struct(F.col(position), F.col(html))).alias("page")).select("celex_id", F.col("page.html").alias("html")))


def assemble_documents(info_pages: DataFrame, text_pages: DataFrame, key: str = "celex_id", position: str = "position", html: str = "html",
                       dates=dates_metadata, misc=misc_metadata, classification=classification_metadata) -> DataFrame:
    """S-15: celex_id, Dates, Misc, Classification, html: metadata of an id's information page, html of its text page.

    Of repeated ids the page of least position counts. An id without an
    information page gives no document; one without a text page has null html.
    Pages are reduced to one for each id before they meet, so a repeated id
    costs its copies no join.
    """
    info = _first_of(info_pages, key, position, html)
    described = info.select("celex_id", dates(F.col("html")).alias("Dates"), misc(F.col("html")).alias("Misc"), classification_texts(classification(F.col("html"))).alias("Classification"))
    return described.join(_first_of(text_pages, key, position, html), "celex_id", "left")
