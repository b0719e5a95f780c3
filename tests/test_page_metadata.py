"""Extractions from fetched pages (S-10 to S-15) on inline pages in the publisher's markup."""

import json

from pyspark.sql import functions as F

from ragtable.functions.elements import Element, elements, stripped_text
from ragtable.operators import page_metadata as M

INFO = """<html><body><!-- <div id="PPDates_Contents"> --><dl class="NMetadata"><dt>Stray:</dt><dd>outside</dd></dl>
<div class="panel" id="PPDates_Contents"><div><dl class="NMetadata other">
 <dt>Date of document: </dt><dd>13/12/2011; Date of <b>adoption</b></dd>
 <dt>Date of signature:</dt><dd>01/01/2012</dd>
 <dt>Date of signature:</dt><dd> 02/01/2012&nbsp;; again</dd>
 <dt>Date of signature:</dt><dd>03/01/2012</dd>
 <dt>Date of end: of validity:</dt><dd>No end date</dd><dt>Surplus:</dt></dl></div><dl class="NMetadata"><dt>Second</dt><dd>list</dd></dl></div>
<div id='PPMisc_Contents'><dl class='NMetadata'><dt>Author:</dt><dd><span lang="en">Council</span><i>x</i><span lang='en'> Parliament </span><span lang="fr">Conseil</span></dd>
 <dt>Form:</dt><dd> Directive &amp; <b>more</b> </dd><dt>Form:</dt><dd></dd></dl></div>
<div id=PPClass_Contents><dl class=NMetadata>
 <dt>EUROVOC descriptor:</dt><dd><ul><li><a><span lang="fr">gaz</span><span lang="en">gas</span><span lang="en">unused</span></a></li><li>no span</li>
  <li><b>outer</b><ul><li><span lang="en">inner</span></li></ul></li></ul></dd>
 <dt>Directory code:</dt><dd><ul><li> 12.10.20.00
   <span lang="en">Energy</span> / <span lang="fr">x</span><span lang="en">Internal market</span></li></ul></dd>
 <dt>Empty:</dt><dd></dd></dl></div></body></html>"""

RESULTS = """<div class="alert alert-info">ok</div><a class="title" href="./outside">no</a><p>Page <strong><b>1</b></strong></p>
<p>Results <strong>1</strong> - <i><strong>nested</strong></i><br><strong>10</strong> of <strong class="n"> 402 </strong> and <strong>9</strong></p><strong>7</strong>
<div class="SearchResult first"><div><a class="big title" href="./legal?uri=CELEX:1&amp;x=1">A</a></div><a href="./untitled">no</a></div>
<div class="NoSearchResult"><a class="title" href="./other">no</a></div><div class='SearchResult'><a class='title' href='./legal?uri=CELEX:2'>B</a><a class=title>none</a></div>"""


def one(spark, column, html):
    return spark.createDataFrame([(html,)], "html string").select(column(F.col("html")).alias("c")).first()["c"]


def test_dates(spark):
    got = one(spark, M.dates_metadata, INFO)
    assert got == {"Date of document": "13/12/2011", "Date of signature": "01/01/2012", "Date of signature 1": "02/01/2012\u00a0", "Date of signature 2": "03/01/2012",
                   "Date of end of validity": "No end date"}
    keys = one(spark, lambda h: F.map_keys(M.dates_metadata(h)), INFO)
    assert keys == ["Date of document", "Date of signature", "Date of signature 1", "Date of signature 2", "Date of end of validity"]
    for html in (None, "", "<p>x</p>", '<div id="PPDates_Contents"></div>', '<div id="PPDates_Contents"><dl class="NMetadata"></dl></div>'):
        assert one(spark, M.dates_metadata, html) == {}


def test_numbered_key_that_exists_already_gives_way_to_the_later(spark):
    html = '<div id="PPDates_Contents"><dl class="NMetadata"><dt>A</dt><dd>1</dd><dt>A</dt><dd>2</dd><dt>A 1</dt><dd>3</dd></dl></div>'
    assert one(spark, M.dates_metadata, html) == {"A": "1", "A 1": "3"}


def test_misc(spark):
    assert one(spark, M.misc_metadata, INFO) == {"Author": "Council, Parliament", "Form": "Directive &more", "Form 1": ""}


def test_classification(spark):
    got = one(spark, M.classification_metadata, INFO)
    assert got["lists"] == {"EUROVOC descriptor": ["gas", "inner", "inner"], "Empty": []}
    assert got["directory"] == {"code": "12.10.20.00", "level 1": "Energy", "level 2": "Internal market"}
    none = one(spark, M.classification_metadata, "<p>")
    assert none["lists"] == {} and none["directory"] == {}
    texts = one(spark, lambda h: M.classification_texts(M.classification_metadata(h)), INFO)
    assert json.loads(texts["Directory code"])["level 2"] == "Internal market" and json.loads(texts["Empty"]) == []


def test_result_links_and_count(spark):
    base = "https://eur-lex.europa.eu/"
    links = [base + "legal?uri=CELEX:1&x=1", base + "legal?uri=CELEX:2"]
    assert one(spark, M.result_links, RESULTS) == links
    assert one(spark, M.result_links, "<p>nothing</p>") is None and one(spark, M.result_links, None) is None
    assert one(spark, M.result_links, RESULTS + '<div class="alert alert-warning">beyond the <b>maximum</b> number</div>') == links
    assert one(spark, M.result_links, '<div class="alert alert-warning">the maximum number of pages</div>' + RESULTS) is None
    rows = M.extract_result_links(spark.createDataFrame([(5, RESULTS), (6, None)], "page_id int, html string")).collect()
    assert [(r.page_id, r.position, r.link) for r in rows] == [(5, 0, links[0]), (5, 1, links[1])]
    assert one(spark, M.result_count, RESULTS) == 402
    for html in (None, "", "<p><strong>1</strong><strong>2</strong></p><strong>3</strong>", "<strong>1</strong><strong>2</strong><strong>1,402</strong>"):
        assert one(spark, M.result_count, html) is None


def test_link_count_check_reports_each_row(spark):
    rows = [(1, RESULTS), (2, RESULTS.replace(" 402 ", "2")), (3, None)]
    pages = spark.createDataFrame(rows, "page_id int, html string")
    checked = pages.select("page_id", M.link_count_check(M.result_count(F.col("html")), M.result_links(F.col("html"))).alias("c")).collect()
    assert {r.page_id: tuple(r.c) for r in checked} == {1: (402, 2, False), 2: (2, 2, True), 3: (None, 0, False)}


def test_nested_unclosed_and_hidden_elements(spark):
    html = "<ul><li>a<ul><li>b</li></ul></li><li>c<script>'<li>no</li>'</script></ul></li><li title='</li>'>d"
    got = one(spark, lambda h: F.transform(elements(F.regexp_replace(h, "(?is)<script.*?</script>", ""), Element("li")), lambda e: stripped_text(e["inner"])), html)
    assert got == ["ab", "b", "c", "d"]


def test_assemble_documents(spark):
    info = spark.createDataFrame([("1", 2, INFO), ("1", 1, INFO.replace("13/12/2011", "14/12/2011")), ("2", 1, "<p>"), ("4", 1, None), (None, 1, INFO)], "celex_id string, position int, html string")
    text = spark.createDataFrame([("1", 9, "later"), ("1", 3, "first"), ("3", 1, "orphan"), ("4", 1, "")], "celex_id string, position int, html string")
    got = {r.celex_id: r for r in M.assemble_documents(info, text).collect()}
    assert set(got) == {"1", "2", "4"}
    assert got["1"].html == "first" and got["1"].Dates["Date of document"] == "14/12/2011" and got["1"].Misc["Author"] == "Council, Parliament"
    assert got["2"].html is None and got["2"].Dates == {} and got["2"].Classification == {} and got["4"].html == ""
    assert M.assemble_documents(info.limit(0), text).count() == 0
