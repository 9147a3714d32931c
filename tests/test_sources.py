import io
import urllib.error
import zipfile

from pyspark.sql import functions as F

from palimpsest.operators import enrich, export, watch
from palimpsest.sources import http
from palimpsest.sources.pages import html_pages, read_html, read_wikitext
from palimpsest.sources.store import VersionStore
from palimpsest.sources.workbook import SCHEMA, read_workbooks, write_workbooks

HTML = """<html><head><title>t</title></head><body><h1><span class="mw-page-title-main">Name</span></h1><div id="description"> About &amp; more </div>
<figure><a href="/f.pdf"><img src="/t.png"></a></figure>
<table class="wikitable"><tr><th>No</th><th> What </th></tr><tr><td> 1 </td><td><a href="/a">A</a> b <a href="/z">z</a></td></tr><tr></tr><tr><td>2</td><td></td></tr></table>
<table class="wikitable"><tr><td>other</td></tr></table><li id="footer-info-lastmod">edited 19:15, 20 травня 2023.</li></body></html>"""


def test_html():
    page = read_html(HTML)
    assert page["title"] == "Name" and page["description"] == "About & more"
    assert page["header"] == ["No", "What"]
    assert page["children"] == [
        [{"text": "1", "link": None}, {"text": "A b z", "link": "/a"}],
        [{"text": "2", "link": None}, {"text": "", "link": None}],
    ]
    assert (page["doc_link"], page["thumb_link"]) == ("/f.pdf", "/t.png")
    assert page["lastmod"] == "edited 19:15, 20 травня 2023."
    assert read_html(None)["children"] == [] and read_html("<table class=wikitable><tr><td>x")["children"] == [[{"text": "x", "link": None}]]


def test_title_as_it_stands():
    html = "<html>\n<p>x</p>\n <h1 class='a'>\n a &quot;b&quot; <i>&lt;c</i> d &am</h1><p>e</p>"
    page = read_html(html)
    assert page["title_html"] == "\n a &quot;b&quot; <i>&lt;c</i> d &am" and page["title"] == 'a "b" <c d &am'
    assert read_html("<h1></h1><h1>b &amp</h1><h1>c</h1>")["title_html"] == "b &amp" and read_html("<h1>open &am")["title_html"] == "open &am"
    assert read_html("<p>x")["title_html"] == "" and read_html("<h1><span class=mw-page-title-main>a</span></h1>")["title"] == "a"


def test_html_pages(spark):
    raw = spark.createDataFrame([(1, HTML), (2, None)], "id int, html string")
    got = {r.id: r for r in html_pages(raw).collect()}
    assert got[1].children[0][1].link == "/a" and got[2].children == []


def test_wikitext():
    text = """{{Архіви|назва=Фонд [[X|ікс]]|рік=1900|примітки=[[File:A b.pdf]]}}
{| class="wikitable sortable"
! № !! Назва
|-
| 1 || [[/1/|перша]] [http://x.org y]
|-
| 2
| '''друга'''
|}
[[Category:Z]]"""
    page = read_wikitext(text)
    assert page["template"] == "Архіви" and page["dates"] == "1900" and page["files"] == ["File:A b.pdf]]"]
    assert page["header"] == ["№", "Назва"]
    assert page["children"] == [
        [{"text": "1", "link": None}, {"text": "перша y", "link": "/1/"}],
        [{"text": "2", "link": None}, {"text": "друга", "link": None}],
    ]
    assert [c[0]["link"] for c in read_wikitext("[[/1/]] [[/2|b]] [[C:x]]")["children"]] == ["/1/", "/2"]
    assert [c[0]["link"] for c in read_wikitext("[[C:x]] and [[c:y]]")["children"]] == ["C:x", "c:y"]
    assert read_wikitext(None)["children"] == []


def test_store(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "pages"))
    assert store.all().count() == 0 and store.load("a", "p").count() == 0
    rows = [("a", "p", "2023", "old"), ("a", "p", "2024", "new"), ("a", "q", "2022", "other"), ("b", "p", "2020", "b")]
    store.save(spark.createDataFrame(rows, store.SCHEMA))
    store.save(spark.createDataFrame([("a", "p", "2024", "again")], store.SCHEMA))
    assert store.load("a", "p").first().payload == "new" and store.load("a", "p", "2023").first().payload == "old"
    assert store.newest().count() == 3
    store.remove("a", "nothing")
    store.remove("a", "p")
    assert store.load("a", "p").count() == 0 and store.newest().count() == 2
    store.remove("a", "q")
    assert [r.archive for r in store.all().collect()] == ["b"]


class Answer(io.BytesIO):
    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


def test_http_tries_again():
    waits, calls = [], []

    def opener(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(url, 429, "slow", {}, None)
        return Answer(b"body")

    assert http.get("u", opener, waits.append) == "body" and len(waits) == 2 and 1 <= waits[0] <= 2 <= waits[1] <= 3

    def missing(url, timeout):
        raise urllib.error.HTTPError(url, 404, "no", {}, None)

    assert http.get("u", missing, waits.append) is None
    assert http.delay(9) == 30.0


def test_page_source_plans_few_readers():
    reader = http.PageSource({"urls": "a b c", "readers": "2"}).reader(None)
    assert [p.urls for p in reader.partitions()] == [["a", "c"], ["b"]]


def test_translator_waits_and_gives_up():
    waits = []

    def never(texts):
        raise TimeoutError

    assert enrich.patiently(never, wait=waits.append)(["a", "b"]) == [None, None] and waits == [1, 2, 4, 8, 16]


def test_breaker():
    now, calls = [0.0], []

    def fails():
        calls.append(1)
        raise ConnectionError

    breaker = enrich.Breaker(4, lambda: now[0])
    assert [breaker.call(fails, lambda: "no") for _ in range(2)] == ["no", "no"] and len(calls) == 1
    now[0] = 4 * 3600 + 1.0
    assert breaker.call(lambda: "yes", lambda: "no") == "yes"
    assert "ID, DESCRIPTION, DATE, OTHER" in enrich.prompt(["a"], [["1"]] * 5)


def test_store_of_two_writers(spark, tmp_path):
    path = f"file:{tmp_path}/store"
    rows = lambda *x: spark.createDataFrame(list(x), VersionStore.SCHEMA)
    a, b = VersionStore(spark, path), VersionStore(spark, path)
    assert a.all().count() == 0 and a.load("A", "p").count() == 0
    a.save(rows(("A", "p", "1", "a1"), ("B/x", "q", "1", "q1")))
    # Both take the same number for their entries; neither loses rows.
    publish = VersionStore._publish
    waiting = []
    b._publish = lambda entry: waiting.append(entry)
    b.save(rows(("A", "p", "2", "b2")))
    # What is written but not published is not there yet: a reader, and a writer that dies, leave the old version.
    assert {r.payload for r in a.all().collect()} == {"a1", "q1"}
    a.save(rows(("A", "p", "1", "late"), ("A", "r", "1", "r1")))
    publish(b, waiting[0])
    del b._publish
    assert {r.payload for r in a.all().collect()} == {"a1", "q1", "b2", "r1"}
    files = sorted(str(f) for f in tmp_path.rglob("rows/**/*.parquet"))
    a.remove("A", "p")
    b.remove("none", "none")
    assert sorted(str(f) for f in tmp_path.rglob("rows/**/*.parquet")) == files
    assert {r.payload for r in b.all().collect()} == {"q1", "r1"} and b.load("A", "p").count() == 0
    b.save(rows(("A", "p", "1", "again")))
    assert a.load("A", "p").first().payload == "again" and a.load("B/x", "q", "1").first().payload == "q1"
    assert {(r.page, r.modified) for r in a.newest().collect()} == {("p", "1"), ("q", "1"), ("r", "1")}
    import pytest

    with pytest.raises(ValueError):
        a.save(rows(("A", "p", "9", "x")).withColumn("refmod", F.lit("2023")))
    assert a.load("A", "p", "9").count() == 0


def test_workbooks_as_a_sink(spark, tmp_path):
    import pytest

    folder = f"file:{tmp_path}/books"
    rows = [("a/b", 1, 1, "x & <y>", "https://x.org/?a=1&b=\"2\"", "linked"), ("a/b", 1, 28, "=SUM(A1:A2)", None, "changed"), ("a/b", 7, 2, None, None, None), ("Ї", 1, 1, " s\n\x00t ", None, "odd")]
    grid = spark.createDataFrame(rows, SCHEMA)
    write_workbooks(grid, folder)
    got = sorted(map(tuple, read_workbooks(spark, folder).collect()))
    assert got == sorted([rows[0], rows[1], ("a/b", 7, 2, "", None, None), ("Ї", 1, 1, " s\nt ", None, None)])
    names = {p.name for p in (tmp_path / "books").iterdir()}
    assert names == {"a%2Fb.xlsx", "%D0%87.xlsx", "_SUCCESS"}
    # A task that fails for good leaves nothing beside what was there.
    broken = grid.withColumn("text", F.when(F.col("page") == "a/b", F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    with pytest.raises(Exception):  # noqa: B017
        write_workbooks(broken.withColumn("page", F.concat("page", F.lit("2"))), folder)
    assert {p.name for p in (tmp_path / "books").iterdir()} == names
    write_workbooks(grid.limit(0), f"file:{tmp_path}/none")
    assert read_workbooks(spark, f"file:{tmp_path}/none").count() == 0


def test_workbooks_are_moved_and_read_by_few_tasks(spark, tmp_path):
    from palimpsest.sources import workbook

    grid = spark.range(300).selectExpr("CAST(id AS STRING) AS page", "1 AS row", "1 AS col", "'t' || id AS text", "CAST(NULL AS STRING) AS link", "'linked' AS style")
    write_workbooks(grid, f"file:{tmp_path}/books")
    assert sorted(p.name for p in (tmp_path / "books").iterdir()) == sorted([f"{i}.xlsx" for i in range(300)] + ["_SUCCESS"])
    parts = workbook.WorkbookReader(f"file:{tmp_path}/books").partitions()
    # A task has its share of the names, and no path with each.
    assert len(parts) == 1 and sorted(parts[0].names) == sorted(f"{i}.xlsx" for i in range(300))
    back = read_workbooks(spark, f"file:{tmp_path}/books")
    assert sorted(map(tuple, back.collect())) == sorted((str(i), 1, 1, f"t{i}", None, "linked") for i in range(300))
    # The sink alone gives the same files.
    grid.coalesce(1).write.format("workbooks").mode("append").option("path", f"file:{tmp_path}/alone").save()
    assert {p.name for p in (tmp_path / "alone").iterdir()} == {p.name for p in (tmp_path / "books").iterdir()}


def test_commit_names_folders_not_files(tmp_path):
    import pyarrow as pa

    from palimpsest.sources.workbook import COLUMNS, WorkbookWriter

    rows = [(str(i), 1, 1, "t", None, None) for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], COLUMNS)
    writer = WorkbookWriter(f"file:{tmp_path}", "job")
    message = writer.write(iter([batch]))
    assert message.files == 50 and not hasattr(message, "names")
    writer.commit([message, None])
    assert [p.name for p in tmp_path.iterdir()] == ["_aside-job"]
    assert {p.name for p in (tmp_path / "_aside-job").iterdir()} == {message.folder.rsplit("/", 1)[-1], "_whole.json"}


def test_workbook():
    data = export.write_workbook({"one & two": [(1, 1, "a<b"), (2, 28, "=SUM(A1:A2)")], "empty": []})
    file = zipfile.ZipFile(io.BytesIO(data))
    assert file.testzip() is None
    sheet = file.read("xl/worksheets/sheet1.xml").decode()
    assert "a&lt;b" in sheet and '<c r="AB2"><f>SUM(A1:A2)</f></c>' in sheet


def test_watch_cycle(spark):
    items = spark.createDataFrame([("a,b", "unresolved", 0, "2024"), ("a,bc", "unresolved", 0, "2024"), ("a,b", "resolved", 1, "2023")],
                                  "address string, status string, seq int, modified string")
    deep = watch.resolve(items, "a,b,,", deep=True)
    assert deep.where("status = 'unresolved'").count() == 0
    assert watch.resolve(items, "a,b,,", deep=True, delimited=True).where("status = 'unresolved'").count() == 1
    back = watch.unresolve(watch.resolve(items, "a,b"), "a,b")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, items.collect()))
    updates = spark.createDataFrame([("a,b", "2023"), ("a,bc", "2022"), ("z", "2024")], "address string, modified string")
    found = watch.unresolved(updates, items, "2023", "2000")
    assert [tuple(r) for r in found.collect()] == [("z", "2024", "2000")]
    assert F is not None
