from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import links, text, timefmt


def values(spark, column, *inputs):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in frame.orderBy("i").select(column).collect()]


def X():
    return F.col("x")



@pytest.mark.parametrize(
    "prefix,floor",
    [
        ("2024", datetime(2024, 1, 1)),
        ("2024,03", datetime(2024, 3, 1)),
        ("2025,03,01", datetime(2025, 3, 1)),
        ("2025,03,01,10:15", datetime(2025, 3, 1, 10, 15)),
    ],
)
def test_cutoff_floor(prefix, floor):
    assert timefmt.cutoff_floor(prefix) == floor


def test_cutoffs_compare_as_strings(spark):
    stamps = ["2023,12,31,23:59", "2024,01,01,00:00", "2024,03,01,10:15", "2024,03,01,10:16"]
    for cut in ("2024", "2024,03", "2024,03,01", "2024,03,01,10:15"):
        ts = timefmt.parse_standard(X())
        assert values(spark, timefmt.since(ts, cut), *stamps) == [s >= cut for s in stamps]
        assert values(spark, timefmt.until(ts, cut), *stamps) == [s <= cut for s in stamps]


def test_dates(spark):
    assert values(spark, timefmt.from_message(X()), "19:15, 20 травня 2023", "09:01, 1 січня 2021") == ["2023,05,20,19:15", "2021,01,01,09:01"]
    assert values(spark, timefmt.last_modified(X()), "seen 19:15, 20 травня 2023.", "never") == ["2023,05,20,19:15", "never"]
    longer = ["Цю сторінку востаннє відредаговано о 19:15, 20 травня 2023.", "о 19:15 20 травня 2023.", "xyz", "09:01, 1 січня 2021"]
    assert values(spark, timefmt.last_modified(X()), *longer) == ["2023,05,20,19:15", "2023,05,20,19:15", "xyz", "2021,01,01,09:01"]
    assert len(values(spark, timefmt.now(), "")[0]) == 16 == len(values(spark, timefmt.now(True), "")[0])
    assert values(spark, timefmt.display_day(X()), "2023,05,20,19:15", "") == ["20 May 2023", ""]
    assert values(spark, timefmt.display(X()), "2023,05,20,19:15", "2023,05") == ["20 MAY 2023 19:15", "MAY 2023"]
    assert values(spark, timefmt.from_utc(X()), "2023-05-20T19:15:44Z") == ["2023,05,20,19:15"]
    assert values(spark, timefmt.from_input(X()), "2023-05-20") == ["2023,05,20"]


def test_predicates(spark):
    assert values(spark, text.is_numeric(X()), "12", " 12\n", "12-14", "12–14", "12a", "", " 7 ", "1-2-3") == [
        True, True, True, True, False, False, True, False,
    ]
    assert values(spark, text.is_ascii(X()), "", "abc\n", "é") == [True, True, False]
    assert values(spark, links.is_linked(X()), "", None, "/a", "/a&redlink=1") == [False, False, True, False]


def test_text_items(spark):
    items = values(spark, text.text_item(X()), None, "", "12", "abc", "є")
    assert [(i.uk, i.en, i.en_set) for i in items] == [(None, None, True), ("", "", True), ("12", "12", True), ("abc", "abc", True), ("є", None, False)]


def test_text(spark):
    assert values(spark, text.strip_number(X()), "12. Name", "7 x", "none") == ["Name", "x", "none"]
    assert values(spark, text.ascii_filename(X()), "a-b_c d.txt", "-_", "Київ-1_a б", "a-_b", "Щука.pdf") == ["a-b_c_d.txt", "download", "Kiyiv-1_a_b", "ab", "Shchuka.pdf"]
    assert values(spark, text.year_range(X()), "1897 - 1903", "in 12345 and 1812", "1400") == ["1897 - 1903", "1812", ""]
    assert values(spark, text.suffix(X()), "a.b.pdf", "none") == ["pdf", ""]
    parsed = values(spark, text.parse_item(X()), "f1, o2 “All of it”", "f1, o2")
    assert [tuple(p) for p in parsed] == [("f1", "o2", "All of it"), ("f1", "o2", "")]


def test_natural_order(spark):
    names = ["10", "2", "а2", "2а", "x", "Р-285", "Р-5"]
    frame = spark.createDataFrame([(n,) for n in names], "x string").orderBy(text.natural_key(X()))
    assert [r.x for r in frame.collect()] == ["2", "2а", "а2", "Р-5", "10", "Р-285", "x"]


def test_long_numbers_sort(spark):
    names = ["9" * 60, "1" + "0" * 59, "007", "8"]
    frame = spark.createDataFrame([(n,) for n in names], "x string").orderBy(text.natural_key(X()))
    assert [r.x for r in frame.collect()] == ["007", "8", "1" + "0" * 59, "9" * 60]


def test_wikitext(spark):
    body = "[[C:File a b.pdf|x]] [[Категорія:k]] [[/1/|one]] [[ z ]] [https://x.org/a b] and https://y.org/c, [[c:d]]"
    found = values(spark, links.link_classes(X()), body, "", None)
    base = "https://commons.wikimedia.org/wiki/"
    assert tuple(found[0]) == ([f"{base}File_a_b.pdf", f"{base}d"], ["Категорія:k"], ["/1/", "z"], ["https://x.org/a", "https://y.org/c,"])
    assert tuple(found[1]) == ([], [], [], [])
    files = "[[File:a.jpg|thumb]] {{t|x=[[file:b.png]]|y=File:c d.pdf}} {{u|https://x.org/wiki/File:e_f.pdf}} File:outside {{File:c d.pdf}}"
    assert sorted(values(spark, links.file_links(X()), files)[0]) == ["File:a.jpg", "File:c d.pdf", "File:e f.pdf", "File:e_f.pdf", "file:b.png"]
    url = links.document_url(links.link_classes(X()), links.link_classes(F.lit("[[c:n]]")), F.lit("A"), "https://x.org")
    assert values(spark, url, "[[/1/]] [[b]]", "none") == ["https://x.org/wiki/A/1", base + "n"]
    sub = links.subarchive(X(), F.when(X() == "A/red", "redlink").otherwise("/x"), "A")
    assert values(spark, sub, "A/x", "A/x/y", "A/red", "A/видання", "B/x", "A") == ["x", None, None, None, None, None]


def test_nested_wikitext(spark):
    targets = lambda c: F.transform(links.wikilinks(c), lambda x: x["target"])
    cases = {
        "[[File:p.jpg|thumb|see [[y]]]] <!-- [[hidden]] --> <nowiki>[[raw]]</nowiki>": ["File:p.jpg", "y"],
        "[[a [[b]] c]] ]] {{ [[u|v|w]] | [[": ["b", "u"],
        "{{t|[[x]]|n={{u|[[y|{{v}}]]}}}} [[z}}]]": ["x", "y", "z}}"],
        "[[a\nb]] [[c]": [],
        "": [],
        None: None,
    }
    assert values(spark, targets(X()), *cases) == list(cases.values())
    files = {
        "{{a|{{b}}|File:x.jpg}}": ["File:x.jpg"],
        "{{box|f=File:[[q]].jpg}}": ["File:[[q]].jpg"],
        "{{a|{{b|File:in.jpg}}|c=[[File:d.png|x]]}}": ["File:d.png", "File:in.jpg"],
        "File:outside [[file:l.pdf]] {{File:name.jpg}}": ["file:l.pdf"],
        None: None,
    }
    assert values(spark, links.file_links(X()), *files) == list(files.values())
    found = values(spark, links.link_classes(X()), "[[Category:x]] [[Категорія:y]] [[c:z]]")[0]
    assert (found["internal_links"], found["category_links"]) == (["Category:x"], ["Категорія:y"])
    text = "[[File:a|b [[c]]]] {{t|x=[[d]]}} " * 200
    assert values(spark, F.size(links.wikilinks(X())), text) == [600]


def test_entities(spark):
    import html

    cases = ["a &amp; b", "&amp;lt;", "&lt;&#39;&#x41;&eacute;&gt;", "&nope; & &; &#0; R&D", "&#128512;x", "plain", ""]
    want = [html.unescape(c) if "&#0;" not in c else c for c in cases]
    assert values(spark, text.unescaped(X()), *cases, None) == [*want, None]


def test_prototypes(spark):
    from palimpsest.operators import export

    form = spark.createDataFrame([(1, 1, "{edit:added}"), (2, 3, "x {edit:changed} {title}"), (3, 1, "{child[0]}")], "row int, col int, text string")
    assert sorted(map(tuple, export.prototypes(form).collect())) == [("added", 1, 1), ("changed", 2, 3)]


def test_state(spark):
    from palimpsest.operators import state

    assert values(spark, state.answers(X(), F.lit(2)), '["a","b"]', '["a"]', '{"a":1}', "no", None, "[1") == [["a", "b"], None, None, None, None, None]
    assert values(spark, state.is_comparison(X(), F.lit("a")), "a", "b", None) == [False, True, False]
    assert values(spark, state.is_clickable(X(), F.lit("/a")), "case", "opus", None) == [False, True, False]
    assert values(spark, state.progress_line(X(), F.lit(3), F.lit(4)), "p") == ["p 3/4 75.0%"]
    assert values(spark, state.numeric_order(F.split(X(), ",")), "10,9,2") == [["2", "9", "10"]]
    order = spark.createDataFrame([("b",), ("A",), ("a",), ("É",), ("f",)], "x string").orderBy(state.collated(X()))
    assert [r.x for r in order.collect()] == ["a", "A", "b", "É", "f"]


def test_progress_is_rounded_as_printf_does(spark):
    from palimpsest.operators import state

    # Ties that a double holds exactly go to the even tenth; 0.35, 0.05 and 1.15 are no ties, being a little beside.
    for progress, total in [(5, 16), (3, 16), (7, 2000), (1, 2000), (23, 2000), (1, 3), (0, 7), (7, 7), (9, 8), (1999, 2000), (1, 10**9)]:
        line = state.progress_line(X(), F.lit(progress), F.lit(total))
        assert values(spark, line, "p") == [f"p {progress}/{total} {100.0 * progress / total:.1f}%"]


def test_grid_decodes_entities_before_pages_meet_children(spark):
    from palimpsest.operators import export

    form = spark.createDataFrame([(1, 1, "{title} {title}"), (2, 1, "{title}: {child:sheetname}"), (2, 2, "{child[N]}")], "row int, col int, text string")
    children = spark.sql("select 1 as page, id as ord, array(struct('a &lt;' as text, '/x' as link)) as cells from range(2)")
    pages = spark.sql("select 1 as page, 'archive' as kind, '1' as id, 'p' as parent, map('title', 'T &amp; &#85; &bad; &') as fields, map('N', 0) as header")
    grid = export.grid(form, children, 2, pages)
    title = "T & U &bad; &"
    want = [(1, 1, f"{title} {title}"), *[x for r in (2, 3) for x in ((r, 1, f"{title}: Fund a <"), (r, 2, "a <"))]]
    assert sorted((r.row, r.col, r.text) for r in grid.collect()) == want
    # A row of a child has no entity left to decode when it is made.
    plan = grid._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and "regexp_extract_all" not in plan[: plan.index("Join ")]


def test_formulas(spark):
    from palimpsest.operators import export

    assert values(spark, export.fill_formula(X(), F.lit("B"), F.lit(3), F.lit(4)), "=SUM(__COL__)") == ["=SUM(B3:B6)"]
    for formula, want in [("=A1+$B2*C$3", "=A3+$B4*C$3"), ('="A1"&A1', '="A1"&A3'), ("=LOG10(A2)", "=LOG10(A4)"), ("=1", "=1")]:
        assert values(spark, export.moved_formula(formula, F.lit(2)), "") == [want]
    names = [export.sheet_name(F.lit(k), F.lit("7"), F.lit("P"), F.lit("Q")) for k in ("archive", "fond", "opus")]
    assert spark.range(1).select(F.array(*names)).first()[0] == ["Fund 7", "Q P-7", "sheetname-7"]


def test_links(spark):
    targets = ["../x", "../../x y", "./s", "/s//t", "z", "../", "/1/", " /a b ", "z/", "//u"]
    want = ["A/x", "x_y", "A/B/s", "A/B/s/t", "z", "A", "A/B/1", "A/B/a_b", "z/", "A/B/u"]
    assert values(spark, links.expand_target(X(), F.lit("A/B"), "https://x.org"), *targets) == [f"https://x.org/wiki/{w}" for w in want]
    assert values(spark, links.percent_encode(X()), "Архів:a/b c~*+.") == ["%D0%90%D1%80%D1%85%D1%96%D0%B2%3Aa/b%20c~%2A%2B."]
    assert values(spark, links.old_id(X()), "a?oldid=17&x", "a") == [17, 0]
    assert values(spark, links.title_address(F.lit("T"), F.lit("_"), X()), "N/1/2/3/4", "N") == ["T,_,1,2,3", "T,_,,,"]
    bag = F.array(F.lit("a"), F.lit("b"), F.lit("a"))
    assert values(spark, links.subtract_links(bag, F.array(F.lit("a"), F.lit("z"))), "") == [["b", "a"]]
