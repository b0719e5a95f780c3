"""Footnote inlining (P-07) and the split at headers (C-08) on inline pages."""

from pyspark.sql import functions as F

from ragtable.functions.footnotes import resolve_footnotes
from ragtable.functions.html import html_to_text
from ragtable.operators.header_split import html_header_split

BODY = (
    '<p class="oj-normal">objectives of Regulation (EU)&nbsp;2020/852 of the&nbsp;Council&nbsp;'
    '<a id="ntc6-E0006" href="#ntr6-E0006">(<span class="oj-super oj-note-tag">6</span>)</a>.</p> '
)
NOTE = (
    '<p class="oj-note"><a id="ntr6-E0006" href="#ntc6-E0006">(<span class="oj-super">6</span>)</a>&nbsp;&nbsp;Regulation (EU)&nbsp;2020/852 '
    'of 18&nbsp;June 2020 (<a href="./AUTO/?uri=OJ:L:2020:198:TOC">OJ&nbsp;L&nbsp;198, p.&nbsp;13</a>).</p>'
)


def resolved(spark, html):
    rows = spark.createDataFrame([(html,)], "html string").select(resolve_footnotes(F.col("html")).alias("h"))
    return rows.select("h", html_to_text(F.col("h")).alias("t")).first()


def test_footnote_is_inlined_and_its_note_removed(spark):
    h, t = resolved(spark, BODY + NOTE)
    assert "oj-note\"" not in h and "ntr6" not in h
    assert "Council\u00a0(Regulation (EU) 2020/852 of 18 June 2020 (OJ L 198, p. 13).)" in t.replace("\n", "")
    flat = t.replace("\u00a0", " ").replace("\n", "").strip()
    assert flat == "objectives of Regulation (EU) 2020/852 of the Council (Regulation (EU) 2020/852 of 18 June 2020 (OJ L 198, p. 13).)."


def test_other_links_and_notes(spark):
    other = '<p>a <a href="#x">top</a> <a href="y">b</a></p>'
    assert resolved(spark, other)["h"] == other
    assert resolved(spark, None)["h"] is None and resolved(spark, "")["h"] == ""
    # a note without a link goes, the last of two notes with one id counts, markup in its text stays text
    two = '<p>q<a href="#n">1</a></p>' + "".join(f'<p class="z oj-note"><a id="n">(1)</a> {x}</p>' for x in ("old", "a &lt; b &amp; c"))
    assert resolved(spark, two + '<p class="oj-note">no link</p>')["h"] == "<p>q(a &lt; b &amp; c)</p>"
    # a class that only begins alike is no note
    tag = '<p class="oj-note-tag"><a id="n">(1)</a> x</p>'
    assert resolved(spark, tag)["h"] == tag


def test_header_split(spark):
    page = "<p>start</p><h1>One</h1><p>a</p><h2 class='k'>One <b>x</b></h2><p>b</p><h3>kept</h3><p>c</p><h1>Two</h1>  <h2>empty</h2><h1>Three</h1>z"
    df = spark.createDataFrame([(1, page), (2, None), (3, "no header"), (4, "")], "page_id int, html string")
    got = html_header_split(df, [("h1", "Header 1"), ("h2", "Header 2")], "html").orderBy("page_id", "chunk_index")
    assert got.columns == ["page_id", "chunk_index", "html", "HTMLSplitter_Header 1", "HTMLSplitter_Header 2"]
    assert [tuple(r) for r in got.collect()] == [
        (1, 0, "start", None, None),
        (1, 1, "a", "One", None),
        (1, 2, "b kept c", "One", "One x"),
        (1, 3, "z", "Three", None),
        (3, 0, "no header", None, None),
    ]


def test_character_references(spark):
    from html import unescape

    from ragtable.functions.html import unescape_entities

    texts = ["a &lt;b&gt; &amp;lt; &copy &nbsp;x &#8364; &#x20AC; &#X1F600;&#39;&#039;", "no reference & none &unknown; &;", "", None, "&#65", "&euro;", "&quot;&apos;&hellip;", "$1 \\ &amp;amp;"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(unescape_entities(F.col("t")).alias("u")).collect()
    assert [r.u for r in rows] == [None if t is None else unescape(t) for t in texts]
    odd = spark.createDataFrame([("&#0; &#xD800; &#1114112;",)], "t string").select(unescape_entities(F.col("t")).alias("u")).first().u
    assert odd == "� � �"
