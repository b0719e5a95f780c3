"""Elements of a page as column expressions, without a DOM.

A page is cut at the start and end tags of one element name, and a fold with a
stack pairs them, so nested elements of that name keep their own contents.
Start tags without an end run to the end of the text they are looked for in,
end tags without a start are passed over. Comments, scripts and styles hold no
elements. Everything happens on the page's row: nothing is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import text_nodes, unescape_entities
from .text import PY_SPACE
from .tokens import let

_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_REST = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
_MARK = "\u0001"

# Elements that have no end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


@dataclass(frozen=True)
class Element:
    """An element name and, where given, one attribute's value; a class is one of the words of ``class`` unless it has spaces itself."""

    tag: str
    attribute: str | None = None
    value: str | None = None

    def fits(self, start_tag: Column) -> Column:
        if self.attribute is None:
            return F.lit(True)
        value = re.escape(self.value)
        words = self.attribute == "class" and " " not in self.value
        quoted = "|".join(f"{q}(?:[^{q}]*\\s)?{value}(?:\\s[^{q}]*)?{q}" if words else f"{q}{value}{q}" for q in ('"', "'"))
        return start_tag.rlike(rf"(?is)\s{re.escape(self.attribute)}\s*=\s*(?:{quoted}|{value}(?=[\s/>]))")


def visible_markup(html: Column) -> Column:
    """The page without comments, scripts and styles; null: empty."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, "")


def _spans(html: Column, tag: str) -> Column:
    """array<struct<at, end, start_tag>> of all elements ``tag`` of visible markup, by where their contents start."""
    pattern = rf"(?is)</?{tag}(?=[\s/>]){_REST}>"
    kind = "struct<pos:int,stack:array<struct<at:int,start_tag:string>>,out:array<struct<at:int,end:int,start_tag:string>>>"
    zero = F.from_json(F.lit('{"pos":0,"stack":[],"out":[]}'), kind)
    steps = F.zip_with(F.regexp_extract_all(html, F.lit(pattern), 0), F.split(html, pattern), lambda mark, text: F.struct(mark.alias("mark"), F.length(text).alias("skip")))

    def step(acc, x):
        begin = acc["pos"] + x["skip"]
        pos = begin + F.coalesce(F.length(x["mark"]), F.lit(0))
        top = F.element_at(acc["stack"], -1)
        closes = x["mark"].startswith("</") & (F.size(acc["stack"]) > 0)
        opens = x["mark"].isNotNull() & ~x["mark"].startswith("</")
        stack = (F.when(opens, F.concat(acc["stack"], F.array(F.struct(pos.alias("at"), x["mark"].alias("start_tag")))))
                 .when(closes, F.slice(acc["stack"], 1, F.greatest(F.size(acc["stack"]) - 1, F.lit(0)))).otherwise(acc["stack"]))
        out = F.when(closes, F.concat(acc["out"], F.array(F.struct(top["at"].alias("at"), begin.alias("end"), top["start_tag"].alias("start_tag"))))).otherwise(acc["out"])
        return F.struct(pos.alias("pos"), stack.alias("stack"), out.alias("out"))

    def finish(acc):
        open_ones = F.transform(acc["stack"], lambda s: F.struct(s["at"].alias("at"), acc["pos"].alias("end"), s["start_tag"].alias("start_tag")))
        return F.array_sort(F.concat(acc["out"], open_ones))

    return F.aggregate(steps, zero, step, finish)


def elements(markup: Column, element: Element) -> Column:
    """array<struct<start_tag, inner>> of the elements in visible markup, nested ones too, in document order."""
    return let(markup, lambda m: F.transform(F.filter(_spans(m, element.tag), lambda s: element.fits(s["start_tag"])),
                                             lambda s: F.struct(s["start_tag"].alias("start_tag"), F.substring(m, s["at"] + 1, s["end"] - s["at"]).alias("inner"))))


def inner_of_first(markup: Column, *path: Element) -> Column:
    """Contents of the first element, then of the first inside it, and so on; null where one is missing."""
    for element in path:
        markup = F.get(elements(markup, element), 0)["inner"]
    return markup


def attribute(start_tag: Column, name: str) -> Column:
    """An attribute's value with entities decoded; null without the attribute."""
    pattern = rf"(?is)\s{re.escape(name)}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"
    found = F.get(F.regexp_extract_all(start_tag, F.lit(pattern), 1), 0)
    return unescape_entities(F.regexp_replace(found, "^[\"']|[\"']$", ""))


def raw_text(markup: Column) -> Column:
    """Text nodes of markup end to end, entities decoded."""
    return unescape_entities(F.array_join(text_nodes(markup), ""))


def stripped_text(markup: Column) -> Column:
    """Text nodes of markup, each stripped, end to end."""
    marked = unescape_entities(F.array_join(text_nodes(markup), _MARK))
    return F.regexp_replace(F.regexp_replace(marked, f"{PY_SPACE}*{_MARK}{PY_SPACE}*", ""), f"^{PY_SPACE}+|{PY_SPACE}+$", "")


def following_siblings(markup: Column, tag: str) -> Column:
    """Contents of the elements ``tag`` that stand beside each other in markup from its start, until what holds them ends."""
    pattern = rf"(?is)</?[a-z][a-z0-9]*(?=[\s/>]){_REST}>"
    kind = "struct<pos:int,depth:int,from:int,out:array<struct<at:int,end:int>>>"
    zero = F.from_json(F.lit('{"pos":0,"depth":0,"from":-1,"out":[]}'), kind)

    def spans(m):
        steps = F.zip_with(F.regexp_extract_all(m, F.lit(pattern), 0), F.split(m, pattern), lambda mark, text: F.struct(mark.alias("mark"), F.length(text).alias("skip")))

        def step(acc, x):
            begin = acc["pos"] + x["skip"]
            pos = begin + F.coalesce(F.length(x["mark"]), F.lit(0))
            name = F.lower(F.regexp_extract(x["mark"], "(?i)^</?([a-z0-9]+)", 1))
            alone = x["mark"].isNull() | name.isin(*VOID) | x["mark"].endswith("/>")
            opens, ended = ~alone & ~x["mark"].startswith("</"), acc["depth"] < 0
            depth = F.when(alone | ended, acc["depth"]).when(opens, acc["depth"] + 1).otherwise(acc["depth"] - 1)
            begins = ~ended & opens & (acc["depth"] == 0) & (name == tag)
            closes = ~ended & ~alone & ~opens & (acc["depth"] == 1) & (acc["from"] >= 0)
            out = F.when(closes, F.concat(acc["out"], F.array(F.struct(acc["from"].alias("at"), begin.alias("end"))))).otherwise(acc["out"])
            return F.struct(pos.alias("pos"), depth.alias("depth"), F.when(begins, pos).when(closes, F.lit(-1)).otherwise(acc["from"]).alias("from"), out.alias("out"))

        return F.aggregate(steps, zero, step, lambda acc: acc["out"])

    return let(markup, lambda m: F.transform(spans(m), lambda s: F.substring(m, s["at"] + 1, s["end"] - s["at"])))
