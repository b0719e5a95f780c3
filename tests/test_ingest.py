"""Incremental ingest (S-16): the rule row by row, reruns, lost runs and rival runs."""

import pytest

from ragtable.sources import ingest

SCHEMA = "celex_id string, position int, Dates map<string,string>, Misc map<string,string>, Classification map<string,string>, html string"


def _brute(stored, rows):
    """The rule applied one row after the other: (table, incomplete rows)."""
    table, n = dict(stored), 0
    for key, _, dates, html in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1], r[3] or "", str(r[2]))):
        if key in table and table[key][0]:
            continue
        if not html:
            n += 1
            continue
        n += not dates
        table[key] = (dates, html)
    return table, n


def _frame(spark, rows):
    return spark.createDataFrame([(k, p, d, {}, None, h) for k, p, d, h in rows], SCHEMA).repartition(3)


def _content(df):
    return {r.celex_id: (dict(r.Dates or {}), r.html) for r in df.collect()}


FIRST = [("a", 1, {"x": "1"}, "A"), ("b", 2, {}, "B"), ("c", 3, {}, ""), ("c", 4, {"y": "2"}, None), ("d", 5, {}, "D1"), ("d", 6, {"z": "3"}, "D2"), ("d", 7, {"z": "4"}, "D3"),
         ("d", 8, {}, ""), ("e", 9, {}, "E1"), ("e", 10, {}, "E2"), ("e", 11, {}, None), (None, 12, {"x": "1"}, "N")]
SECOND = [("a", 1, {"x": "9"}, "late"), ("b", 2, {"w": "5"}, "B2"), ("c", 3, {}, "C"), ("e", 4, {}, ""), ("f", 5, {"v": "6"}, "F")]


def test_versions_follow_the_rule_and_reruns_change_nothing(spark, tmp_path):
    table = ingest.DocumentTable(spark, str(tmp_path / "t"))
    assert table.version() == 0 and table.read().count() == 0
    want, n = _brute({}, FIRST)
    report = table.ingest(_frame(spark, FIRST))
    assert (report.version, report.n_incomplete) == (1, n) and _content(table.read()) == want
    again = table.ingest(_frame(spark, FIRST))
    assert again.version == 1 == table.version() and _content(table.read()) == want
    more, n = _brute(want, SECOND)
    report = table.ingest(_frame(spark, SECOND))
    assert (report.version, report.complete, report.incomplete, report.n_incomplete) == (2, 2, 1, n)
    assert _content(table.read()) == more and _content(table.read(1)) == want
    assert table.ingest(_frame(spark, []).limit(0)).version == 2
    merged = ingest.upsert(table.read(1), _frame(spark, SECOND))
    assert _content(merged) == more


def test_a_run_that_ends_early_or_loses_a_race_leaves_the_table(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    table = ingest.DocumentTable(spark, root)
    table.ingest(_frame(spark, FIRST))
    before = _content(table.read())

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(ingest.DocumentTable, "_publish", dies)
        with pytest.raises(KeyboardInterrupt):
            table.ingest(_frame(spark, SECOND))
    assert table.version() == 1 and _content(table.read()) == before
    rival, publish = ingest.DocumentTable(spark, root), ingest.DocumentTable._publish

    def second(self, version, manifest):
        publish(rival, version, manifest)
        publish(self, version, manifest)

    with monkeypatch.context() as m:
        m.setattr(ingest.DocumentTable, "_publish", second)
        with pytest.raises(RuntimeError, match="another ingest"):
            table.ingest(_frame(spark, SECOND))
    assert _content(ingest.DocumentTable(spark, root).read()) == _brute(before, SECOND)[0]
