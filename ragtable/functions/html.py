"""HTML to text as column expressions, no DOM (P-05).

Text nodes are what lies between markup: the document is split on one
alternation of comments, script/style elements (dropped whole, their text
is not page text), declarations, processing instructions and tags (quote-aware,
so '>' inside an attribute value does not end a tag). Empty pieces are
dropped, the rest joined with '\\n' (an HTML parser's ``get_text('\\n')``),
entities are decoded *after* splitting (so '&lt;p&gt;' stays text) with
'&amp;' decoded last, and blank-line runs are collapsed (P-06).

The same pattern strings run in Java regex (Spark) and RE2 (DuckDB oracle).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse_blank_lines
from .tokens import let

MARKUP = (
    r"(?is)<!--.*?-->"
    r"|<script\b.*?</script\s*>"
    r"|<style\b.*?</style\s*>"
    r"|<![^>]*>"
    r"|<\?[^>]*>"
    r"|</?[a-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
)

# HTML entity names and the characters they stand for.
# (name, character, semicolon optional as in the HTML legacy forms)
ENTITIES = [
    ("lt", "<", True),
    ("gt", ">", True),
    ("quot", '"', True),
    ("apos", "'", False),
    ("nbsp", "\u00a0", True),
    ("copy", "©", True),
    ("reg", "®", True),
    ("middot", "·", True),
    ("sect", "§", True),
    ("para", "¶", True),
    ("deg", "°", True),
    ("laquo", "«", True),
    ("raquo", "»", True),
    ("euro", "€", False),
    ("hellip", "…", False),
    ("ndash", "–", False),
    ("mdash", "—", False),
    ("lsquo", "‘", False),
    ("rsquo", "’", False),
    ("ldquo", "“", False),
    ("rdquo", "”", False),
    ("#39", "'", False),
    ("#x27", "'", False),
    ("#34", '"', False),
    ("#160", "\u00a0", False),
]


def entity_rules() -> list[tuple[str, str]]:
    """(regex, replacement) pairs, '&amp;' last so '&amp;lt;' decodes to '&lt;'."""
    rules = [(f"&{name};" if not legacy else f"&{name};?", ch) for name, ch, legacy in ENTITIES]
    rules.append(("&amp;?", "&"))
    return rules


def _entity_pattern() -> str:
    """One reference: numeric in either base, or a name of the list; the legacy names also without a semicolon."""
    names = "|".join(f"{name};?" if legacy else f"{name};" for name, _, legacy in [("amp", "&", True), *ENTITIES] if not name.startswith("#"))
    return f"&(?:#[xX][0-9a-fA-F]{{1,6}};?|#[0-9]{{1,7}};?|{names})"


def _entity_map() -> str:
    """SQL map of names and their characters."""
    return "map(" + ", ".join(f"'{name}', '{ch.replace(chr(39), chr(92) + chr(39))}'" for name, ch, _ in [("amp", "&", True), *ENTITIES] if not name.startswith("#")) + ")"


def unescape_entities(c: Column) -> Column:
    """Character references decoded in one pass, so that '&amp;lt;' gives '&lt;'.

    Numeric references stand for any code point (0, surrogates and what lies
    beyond Unicode: U+FFFD); a name that isn't in ENTITIES stays as it is.
    """
    pattern, known = _entity_pattern(), F.expr(_entity_map())

    def character(mark):
        body = F.regexp_replace(mark, "^&|;$", "")
        code = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 6), 16, 10)).when(body.startswith("#"), F.substring(body, 2, 7)).cast("int")
        wrong = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
        point = F.decode(F.unhex(F.lpad(F.hex(F.when(wrong, F.lit(0xFFFD)).otherwise(code)), 8, "0")), "UTF-32")
        return F.coalesce(F.when(code.isNotNull(), point), F.element_at(known, body), mark)

    def decoded(text):
        marks = F.concat(F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), character), F.array(F.lit("")))
        return F.array_join(F.zip_with(F.split(text, pattern), marks, lambda a, b: F.concat(a, b)), "")

    return F.when(c.contains("&"), let(c, decoded)).otherwise(c)


def unescape_sql(expr: str) -> str:
    """The same decoding chain as DuckDB SQL (for oracles)."""
    out = expr
    for pat, rep in entity_rules():
        out = f"regexp_replace({out}, '{pat}', '{rep.replace(chr(39), chr(39) * 2)}', 'g')"
    return out


def text_nodes(html: Column) -> Column:
    """Non-empty pieces of text between markup, in document order."""
    return F.filter(F.split(F.coalesce(html, F.lit("")), MARKUP), lambda s: s != F.lit(""))


def html_to_text(html: Column) -> Column:
    """P-05 (+P-06): page text, one text node per line, blank-line runs collapsed."""
    return collapse_blank_lines(unescape_entities(F.array_join(text_nodes(html), "\n")))


def html_to_text_sql(col: str) -> str:
    from .text import PY_SPACE

    markup = MARKUP.replace("'", "''")
    joined = (f"array_to_string(list_filter(string_split_regex(coalesce({col}, ''), '{markup}'), "
              f"lambda s: s <> ''), chr(10))")
    return f"regexp_replace({unescape_sql(joined)}, '(\\n{PY_SPACE}*\\n)+', chr(10), 'g')"
