"""Comparison of nested pages, documents and depth-first lookup against plain models."""

import json
import random

from pyspark.sql import functions as F

from palimpsest.functions.text import text_item
from palimpsest.operators import diff, lists, tree
from palimpsest.plans import changes

CELL = "struct<text:struct<uk:string,en:string,en_set:boolean>,link:string>"
PAGE = f"page int, lastmod string, title struct<uk:string,en:string,en_set:boolean>, description struct<uk:string,en:string,en_set:boolean>, children array<array<{CELL}>>"


def item(uk, en="-"):
    return (uk, None if en == "-" else en, en != "-")


def told(i):
    return i[1] if i[2] else i[0]


def same(a, b):
    return a[1] == b[1] if a[2] and b[2] else a[0] == b[0]


def is_link(x):
    return x is not None and "redlink" not in x


def model(now, then):
    """(title edit, description edit, refmod, edits of cells)."""
    if then is None:
        return None, None, None, [[(None, None) for _ in row] for row in now[4]]
    old = {told(r[0][0]): r for r in then[4] if r}
    rows = []
    for row in now[4]:
        other = old.get(told(row[0][0])) if row else None
        cells = []
        for i, (text, link) in enumerate(row):
            if other is None:
                cells.append(("added", None))
            elif i >= len(other):
                cells.append((None, None))
            else:
                links = None
                if is_link(link):
                    links = ("changed" if link != other[i][1] else None) if is_link(other[i][1]) else "added"
                cells.append((None if same(text, other[i][0]) else "changed", links))
        rows.append(cells)
    edit = lambda k: None if same(now[k], then[k]) else "changed"
    return edit(2), edit(3), then[1], rows


def random_page(rng, number, time):
    text = lambda: item(rng.choice("abc"), rng.choice(["-", "x", "y", None]))
    cell = lambda: (text(), rng.choice([None, "/a", "/b", "/c?redlink=1"]))
    return (number, time, text(), text(), [[cell() for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(0, 5))])


def test_compare_pages(spark):
    rng = random.Random(5)
    now = [random_page(rng, i, "2024") for i in range(120)]
    then = [random_page(rng, i, "2023") for i in range(100)]
    got = {r.page: r for r in diff.compare_pages(spark.createDataFrame(now, PAGE), spark.createDataFrame(then, PAGE)).collect()}
    for page in now:
        r = got[page[0]]
        want = model(page, then[page[0]] if page[0] < 100 else None)
        assert (r.title.edit, r.description.edit, r.refmod, [[(c.edit, c.link_edit) for c in row] for row in r.children]) == want, page
    assert len(got) == len(now)
    document = lists.page_document(
        diff.compare_pages(spark.createDataFrame(now[:1], PAGE), spark.createDataFrame(then[:1], PAGE)).withColumns(
            {"archive": F.lit("A"), "subarchive": F.lit("D"), "name": F.lit("A/1/2"), "kind": F.lit("opus"), "link": F.lit("/l"), "doc_link": F.lit("/d"), "header": F.array(text_item(F.lit("Ї"))), "history": F.array(F.lit("h"))}
        )
    )
    found = json.loads(document.first().json)
    # The documented keys, but for the case that the address lacks.
    assert set(found) == set("archive children description doc_link fond header history kind lastmod link name needs_translation opus subarchive title".split())
    assert (found["fond"], found["opus"], found["needs_translation"], found["header"]) == ("1", "2", True, [{"uk": "Ї"}])


def test_diff_of_repeated_keys(spark):
    schema = "page int, row_key string, row int, col int, text struct<uk:string,en:string,en_set:boolean>, link string"
    now = [(1, "k", 1, 1, item("new"), "/n"), (1, None, 2, 1, item("x"), None), (1, "k", 1, 2, item("y"), None)]
    then = [(1, "k", 1, 1, item("old"), None), (1, "k", 2, 1, item("new"), None), (1, None, 1, 1, item("x"), None)]
    got = diff.diff_cells(spark.createDataFrame(now, schema), spark.createDataFrame(then, schema)).collect()
    assert {(r.row_key, r.col): (r.edit, r.link_edit) for r in got} == {("k", 1): (None, "added"), (None, 1): ("added", None), ("k", 2): (None, None)}


ROW = "page int, row_key string, row int, cells array<struct<col:int,text:struct<uk:string,en:string,en_set:boolean>,link:string>>"


def test_diff_of_rows_is_that_of_cells(spark):
    rng = random.Random(3)
    cell = lambda c: (c, item(rng.choice("abc"), rng.choice(["-", "x", None])), rng.choice([None, "", "/a", "/b", "/c?redlink=1"]))
    some = lambda: [(rng.randrange(6), rng.choice(["k", "l", "m", None]), i, [cell(c) for c in rng.choices((1, 2, 3), k=rng.randint(1, 3))]) for i in range(60)]
    now, then = spark.createDataFrame(some(), ROW), spark.createDataFrame(some(), ROW)
    got = changes.each_cell(diff.diff_rows(now, then))
    want = diff.diff_cells(changes.each_cell(now), changes.each_cell(then))
    columns = ["page", "row_key", "row", "col", "text", "link", "edit", "link_edit"]
    assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))


def generated(spark, query):
    """How often a query makes rows of arrays."""
    return query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("Generate ")


def test_page_compare_gathers_rows_not_cells(spark):
    # Cells are told one by one at the end; before, both versions were dealt to cells and gathered again.
    assert generated(spark, changes.q_page_compare) == 2



def test_change_report_joins_rows_not_cells(spark):
    # Only what an edit is told of is dealt to cells, after the join.
    assert generated(spark, changes.q_change_report) == 1


def test_any_edit_is_told_by_rows(spark):
    assert generated(spark, changes.q_diff_any_edit) == 0



def test_edited_rows_are_told_by_rows(spark):
    assert generated(spark, changes.q_diff_rows_only) == 0



def test_deep_lookup(spark):
    rng = random.Random(8)
    for _ in range(3):
        cells = [(f"p{rng.randrange(8)}", n, rng.choice("abcdef"), rng.choice([f"p{rng.randrange(8)}", f"leaf{n}", None])) for n in range(30)]
        asks = [(f"p{i}", e) for i in range(8) for e in "abcdefg"] + [(None, "a"), ("p1", None), ("none", "a")]

        def first(page, entry, cells=cells):
            """The first hit in depth-first order: a row is looked at, then what is below it; pages are entered once."""
            entered = {page}

            def below(at, place):
                for _, n, key, link in sorted((c for c in cells if c[0] == at), key=lambda c: c[1]):
                    if key == entry:
                        return [*place, n], link
                    if link and link not in entered:
                        entered.add(link)
                        hit = below(link, [*place, n])
                        if hit:
                            return hit
                return None

            return below(page, [])

        found = tree.deep_lookup(spark.createDataFrame(asks, "page string, entry string"), spark.createDataFrame(cells, "page string, ord long, row_key string, link string"))
        got = {(r.page, r.entry): (list(r.place), r.found) for r in found.collect()}
        want = {(p, e): first(p, e) for p, e in asks if p and e and first(p, e)}
        assert got == want


def test_lookup_enters_only_pages_that_lead_to_the_entry(spark):
    cells = [("w", 1, "x", "a"), ("w", 2, "x", "b"), ("a", 1, "x", "a1"), ("b", 1, "x", "b1"), ("b1", 1, "k", "w"), ("a1", 1, "x", "a"), ("a1", 2, "y", None), (None, 1, "k", "b")]
    cells = spark.createDataFrame(cells, "page string, ord long, row_key string, link string")
    asks = spark.createDataFrame([("w", "k"), ("w", "y"), ("w", "gone"), ("w", None)], "page string, entry string")
    leads = {(r.at, r.entry) for r in tree._leading(asks, cells).collect()}
    assert leads == {(p, "k") for p in ("w", "b", "b1")} | {(p, "y") for p in ("w", "a", "a1", "b", "b1")}
    got = {(r.entry, tuple(r.place), r.found) for r in tree.deep_lookup(asks, cells).collect()}
    assert got == {("k", (2, 1, 1), "w"), ("y", (1, 1, 2), None)}


def test_classify_pages(spark):
    from palimpsest.operators import enrich

    def client(questions):
        if any("fails" in q for q in questions):
            raise ConnectionError
        return [q.split("answer=")[1].split("\n")[0] if "answer=" in q else None for q in questions]

    answers = {
        1: '["ID","DESCRIPTION","DATE"]', 2: '["DATE","ID","DESCRIPTION"]', 3: '["ID","ID","DATE"]', 4: '["ID","x","DATE"]', 5: '["ID"]', 6: "no", 7: "{}", 8: '[1,null,"ID"]',
    }
    item_of = lambda t: (t, None, False)
    rows = [(i, [item_of("a"), item_of("b"), item_of("c")], [[(item_of(f"answer={a}"), None)]] * 5) for i, a in answers.items()]
    rows += [(9, [item_of(None)], []), (10, None, None)]
    schema = f"page int, header array<struct<uk:string,en:string,en_set:boolean>>, children array<array<{CELL}>>"
    got = {r.page: (r.labels, r.success, r.header_map) for r in enrich.classify_pages(spark.createDataFrame(rows, schema), client).collect()}
    default = ["ID", "DESCRIPTION", "DATE"]
    assert got[1] == (default, True, {"ID": 0, "DESCRIPTION": 1, "DATE": 2})
    assert got[2] == (["DATE", "ID", "DESCRIPTION"], True, {"DATE": 0, "ID": 1, "DESCRIPTION": 2})
    assert all(got[i][:2] == (default, False) for i in (3, 4, 5, 6, 7, 8))
    assert got[9][:2] == (["ID"], False) and got[10][:2] == ([], False)
    failing = spark.createDataFrame([(1, [item_of("fails")] * 4, [])], schema)
    assert enrich.classify_pages(failing, client).first().labels == [*default, "OTHER"]
    asked = spark.createDataFrame(rows[:1], schema).select(enrich.question(F.col("header"), enrich.samples(F.col("children")), "h").alias("q")).first().q
    assert asked == enrich.prompt(["a", "b", "c"], [[f"answer={answers[1]}"]] * 5, "h")


def test_diff_of_versions_is_that_of_rows(spark):
    rng = random.Random(4)
    cell = lambda c: (c, item(rng.choice("abc"), rng.choice(["-", "x", None])), rng.choice([None, "", "/a", "/b", "/c?redlink=1"]))
    cells = lambda: rng.choice([None, [], *[[cell(c) for c in rng.choices((1, 2, 3), k=rng.randint(1, 3))] for _ in range(6)]])
    some = [(rng.choice([*range(8), None]), rng.choice(["k", "l", "m", None]), i, cells(), cells()) for i in range(90)]
    rows = spark.createDataFrame(some, ROW + ROW[ROW.index(", cells") :].replace("cells", "then"))
    # Of rows without cells the older version has none as cells.
    rows = rows.withColumn("then", F.when(F.size("then") > 0, F.col("then")))
    now = rows.where("cells is not null").drop("then")
    then = rows.where("then is not null").select("page", "row_key", "row", F.col("then").alias("cells"))
    got, told = diff.diff_versions(rows), diff.diff_rows(now, then)
    assert sorted(map(repr, got.select(ROWS).collect())) == sorted(map(repr, told.select(ROWS).collect()))
    columns = ["page", "row_key", "row", "col", "text", "link", "edit", "link_edit"]
    want = diff.diff_cells(changes.each_cell(now), changes.each_cell(then))
    assert sorted(map(repr, changes.each_cell(got).select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))
    for r in got.collect():
        assert r.edited == any(c.edit or c.link_edit for c in r.cells)


ROWS = ["page", "row_key", "row", "cells", "edited"]


def plan_of(spark, query):
    return query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_change_report_deals_rows_once(spark):
    # Both snapshots come from one pass; cells aren't made a first time to see whether there are any.
    plan = plan_of(spark, changes.q_change_report)
    assert plan.count("Exchange") == 1 and "Join" not in plan and plan.count("posexplode") == 1 and "size(" not in plan


def test_any_edit_deals_rows_once(spark):
    plan = plan_of(spark, changes.q_diff_any_edit)
    assert plan.count("Exchange") == 1 and "Join" not in plan and "transform(cells" not in plan


def test_edited_rows_deal_rows_once(spark):
    plan = plan_of(spark, changes.q_diff_rows_only)
    assert plan.count("Exchange") == 1 and "Join" not in plan and "transform(cells" not in plan
