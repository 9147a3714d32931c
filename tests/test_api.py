from datetime import datetime

from palimpsest.api import Library

VERSIONS = "archive string, subarchive string, fond string, opus string, case string, page string, ts timestamp_ntz, revid long, title string"
CELLS = "page string, revid long, row_key string, row int, col int, text struct<uk:string,en:string,en_set:boolean>, link string"


def test_pages_and_watch_lists(spark):
    at = lambda y: datetime(y, 1, 1, 10)
    versions = spark.createDataFrame(
        [("A", "_", "1", "", "", "A/1", at(2020), 1, "old"), ("A", "_", "1", "", "", "A/1", at(2024), 2, "new"), ("B", "_", "", "", "", "B", at(2021), 3, "b")],
        VERSIONS,
    )
    item = lambda t: (t, None, False)
    cells = spark.createDataFrame(
        [("A/1", 1, "r", 1, 1, item("x"), None), ("A/1", 2, "r", 1, 1, item("y"), None), ("A/1", 2, "s", 2, 1, item("z"), "/l")], CELLS
    )
    items = spark.createDataFrame([("B,_,,,", "resolved", 1, "2021,01,01,10:00")], "address string, status string, seq int, modified string")
    log = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "ts int, message string")
    lib = Library(versions, cells, items, log)
    assert sorted(map(tuple, lib.archives().collect())) == [("A", "_"), ("B", "_")]
    where = {"archive": "A", "subarchive": "_", "fond": "1"}
    assert sorted(r.text.uk for r in lib.page(**where).collect()) == ["y", "z"]
    edits = {r.row_key: r.edit for r in lib.page(compare="2022", **where).collect()}
    assert edits == {"r": "changed", "s": "added"}
    assert lib.find(archive="none").count() == 0 and lib.page(archive="none").count() == 0
    assert [r.modified for r in lib.history(**where).orderBy("modified").collect()] == ["2020,01,01,10:00", "2024,01,01,10:00"]
    assert '"title":"new"' in lib.as_json(**where).first().json
    assert [tuple(r) for r in lib.check("2000", "1999").collect()] == [("A,_,1,,", "2024,01,01,10:00", "1999")]
    assert lib.resolve("B").count() == 1 and lib.before("2021").count() == 1
    assert [r.message for r in lib.log(2).collect()] == ["b", "c"]
