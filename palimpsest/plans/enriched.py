"""Translations, labels of columns, maps and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich, export
from ..session import scratch_folder
from ..sources.workbook import read_workbooks, write_workbooks
from ..functions.timefmt import standard
from .registry import query, table
from .texts import ITEMS, items


def shout(texts: list[str]) -> list[str]:
    """A translator for tests: upper-case ASCII letters."""
    return [t.translate({c: c - 32 for c in range(97, 123)}) for t in texts]


@query(
    f"""WITH {ITEMS} SELECT doc_id, uk, CASE WHEN en_set THEN uk ELSE translate(uk, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END AS en, TRUE AS en_set FROM i"""
)
def q_translate_batch(spark, sf_dir):
    """Missing translations: each distinct text is asked for once, and the answers go back to their places."""
    i = items(spark, sf_dir)
    asked = i.where(~F.col("item.en_set")).select(F.col("item.uk").alias("text"))
    return enrich.set_translations(i, "item", enrich.translate(asked, shout)).select("doc_id", "item.*")


LABELS = """l AS (SELECT conv_id AS tab, turn AS pos, CASE turn % 5 WHEN 0 THEN 'ID' WHEN 1 THEN 'DATE' WHEN 2 THEN 'DESCRIPTION' WHEN 3 THEN 'ID' ELSE 'note' END AS label FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY tab, label ORDER BY pos) AS nth FROM l)"""


def labels(spark, sf_dir):
    """(table, pos, label): labels as a classifier might give them, some repeated, some unknown."""
    names = F.get(F.array(*[F.lit(x) for x in ("ID", "DATE", "DESCRIPTION", "ID", "note")]), (F.col("turn") % 5).cast("int"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("table"), F.col("turn").alias("pos"), names.alias("label"))


@query(f"WITH {LABELS} SELECT tab, pos, CASE WHEN label IN ('ID', 'DATE', 'DESCRIPTION') AND nth = 1 THEN label ELSE 'OTHER' END AS label FROM r")
def q_label_normalise(spark, sf_dir):
    return enrich.normalise_labels(labels(spark, sf_dir)).select(F.col("table").alias("tab"), "pos", "label")


@query(
    f"""WITH {LABELS} SELECT tab, count(DISTINCT label) FILTER (label IN ('ID', 'DATE', 'DESCRIPTION')) = 3 AS usable,
count(DISTINCT label) FILTER (label IN ('ID', 'DATE', 'DESCRIPTION')) = 3 AND NOT bool_or(label = 'note' OR nth > 1) AS valid FROM r GROUP BY tab"""
)
def q_label_verdicts(spark, sf_dir):
    return enrich.label_verdicts(labels(spark, sf_dir)).select(F.col("table").alias("tab"), "usable", "valid")


@query(
    f"""WITH {LABELS}, n AS (SELECT tab, pos, CASE WHEN label IN ('ID', 'DATE', 'DESCRIPTION') AND nth = 1 THEN label ELSE 'OTHER' END AS label FROM r)
SELECT tab, label, max(pos) AS index FROM n GROUP BY tab, label"""
)
def q_column_map(spark, sf_dir):
    """Positions by label, the last of repeated ones."""
    normal = enrich.normalise_labels(labels(spark, sf_dir))
    return enrich.column_map(normal).select(F.col("table").alias("tab"), "label", "index")


@query(
    """SELECT conv_id, CASE count(*) WHEN 1 THEN 'ID' WHEN 2 THEN 'ID,DESCRIPTION' WHEN 3 THEN 'ID,DESCRIPTION,DATE'
ELSE 'ID,DESCRIPTION,DATE' || repeat(',OTHER', CAST(count(*) - 3 AS INTEGER)) END AS labels FROM conversations GROUP BY conv_id"""
)
def q_label_defaults(spark, sf_dir):
    sizes = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    return sizes.select("conv_id", F.array_join(enrich.default_labels(F.col("n")), ",").alias("labels"))


@query(
    """WITH s AS (SELECT 1 AS tab, 0 AS pos, CAST(p_partkey AS VARCHAR) AS value FROM part UNION ALL SELECT 1, 1, p_name || ' long name' FROM part
UNION ALL SELECT 1, 2, CAST(1900 + p_size AS VARCHAR) FROM part UNION ALL SELECT 1, 3, p_brand FROM part)
SELECT DISTINCT pos, CASE pos WHEN 0 THEN 'ID' WHEN 1 THEN 'DESCRIPTION' WHEN 2 THEN 'DATE' ELSE 'OTHER' END AS label FROM s"""
)
def q_classify_columns(spark, sf_dir):
    """Labels of a table's columns by rule."""
    values = [F.col("p_partkey").cast("string"), F.concat("p_name", F.lit(" long name")), (F.col("p_size") + 1900).cast("string"), F.col("p_brand")]
    cells = table(spark, sf_dir, "part").select(F.lit(1).alias("table"), F.posexplode(F.array(*values)).alias("pos", "value"))
    return enrich.classify_columns(cells).select("pos", "label")


@query("SELECT quality, count(*) AS n, round(avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM labels GROUP BY quality")
def q_classifier_success(spark, sf_dir):
    """Share of valid answers."""
    ok = F.when(F.col("toxic") == 0, 1.0).otherwise(0.0)
    return table(spark, sf_dir, "labels").groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg(ok), 6).alias("ratio"))


def customer_pages(spark, sf_dir):
    """(page, header, children): a table for each customer, its orders as rows; the first cell leads to a page."""
    cell = lambda text, link: F.struct(F.struct(text.alias("uk"), F.lit(None).cast("string").alias("en"), F.lit(False).alias("en_set")).alias("text"), link.alias("link"))
    key, none = F.col("o_orderkey").cast("string"), F.lit(None).cast("string")
    doc = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("/own/"), key))
    row = F.array(cell(key, F.concat(F.lit("/wiki/O/"), key)), cell(F.col("o_orderstatus"), doc), cell(F.date_format("o_orderdate", "yyyy"), none), cell(F.lit("x"), none))
    pages = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", row.alias("row")))).alias("rows"))
    names = F.array(*[F.struct(F.lit(n).alias("uk"), F.lit(n).alias("en"), F.lit(True).alias("en_set")) for n in ("No", "What", "When", "Etc")])
    return pages.select("page", names.alias("header"), F.transform("rows", lambda r: r["row"]).alias("children"))


def model(questions):
    """A chat model that answers by the first number of the first row: rightly, with a repeat, too short, not at all, or
    with an unknown label."""
    kinds = ['["ID","DESCRIPTION","DATE","OTHER"]', '["ID","ID","DATE","DESCRIPTION"]', '["ID"]', "I can't", '["ID","note","DATE","OTHER"]']
    return [kinds[int(q.split("Row: ")[1].split(" ")[0]) % 5] for q in questions]


CLASSIFIED = """o AS (SELECT o_custkey AS page, min(o_orderkey) % 5 AS k FROM orders GROUP BY o_custkey),
c AS (SELECT page, CASE WHEN k = 1 THEN 'ID,OTHER,DATE,DESCRIPTION' ELSE 'ID,DESCRIPTION,DATE,OTHER' END AS labels, k = 0 AS success, CASE WHEN k = 1 THEN 3 ELSE 1 END AS described FROM o)"""


@query(f"WITH {CLASSIFIED} SELECT page, labels, success, CAST(described AS INTEGER) AS described FROM c")
def q_classify_pages(spark, sf_dir):
    """Labels of the columns of tables, asked by header and first rows, checked, normalised, or the default ones."""
    found = enrich.classify_pages(customer_pages(spark, sf_dir), model)
    return found.select("page", F.array_join("labels", ",").alias("labels"), "success", F.col("header_map")["DESCRIPTION"].alias("described"))


@query(
    f"""WITH {CLASSIFIED} SELECT o_custkey AS page, o_orderkey, labels, CASE WHEN o_orderkey % 4 = 0 THEN '/own/' || o_orderkey WHEN o_orderkey % 3 = 0 THEN '/wiki/File:' || o_orderkey || '-0.pdf' END AS document
FROM orders JOIN c ON page = o_custkey"""
)
def q_prepared_pages(spark, sf_dir):
    """Pages made ready for export: labels of their columns, and documents where rows have none of their own."""
    number = F.col("o_orderkey").cast("string")
    files = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(
        F.concat(F.lit("O/"), number).alias("title"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos"), number.alias("k")
    )
    files = files.select("title", "pos", F.concat(F.lit("/wiki/File:"), "k", F.lit("-"), F.col("pos").cast("string"), F.lit(".pdf")).alias("url"))
    found = enrich.prepared(customer_pages(spark, sf_dir), model, files).select("page", F.array_join("labels", ",").alias("labels"), F.explode("children").alias("row"))
    cell = lambda i: F.get("row", i)
    return found.select("page", cell(0)["text"]["uk"].cast("long").alias("o_orderkey"), "labels", cell(1)["link"].alias("document"))


@query("SELECT n_regionkey, max(n_nationkey) AS n_nationkey FROM nation GROUP BY n_regionkey")
def q_invert_map(spark, sf_dir):
    """A map turned round, the last key of a value winning."""
    entry = F.map_from_arrays(F.array("n_nationkey"), F.array("n_regionkey"))
    each = table(spark, sf_dir, "nation").select(F.explode(entry).alias("key", "value"))
    return each.groupBy(F.col("value").alias("n_regionkey")).agg(F.max("key").alias("n_nationkey"))


@query("SELECT event_id, replace(props, 'k', 'key') AS props FROM events")
def q_nested_replace(spark, sf_dir):
    """A text replaced in the keys and values of a nested structure."""
    swap = lambda c: F.replace(c, F.lit("k"), F.lit("key"))
    parsed = F.from_json("props", "map<string,string>")
    renamed = F.map_from_entries(F.transform(F.map_entries(parsed), lambda e: F.struct(swap(e["key"]).alias("key"), swap(e["value"]).alias("value"))))
    shown = F.transform(F.map_entries(renamed), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"]))
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("{"), F.array_join(shown, ", "), F.lit("}")).alias("props"))


TEMPLATE = [(1, 1, "{title}"), (2, 1, "Part"), (2, 2, "Status"), (3, 1, "{child[0]}"), (3, 2, "{child[1]:link_status}"), (4, 1, "Sum"), (4, 2, "=SUM(__COL__)")]


@query(
    """WITH i AS (SELECT l_orderkey AS page, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) - 1 AS nth FROM lineitem),
n AS (SELECT page, count(*) AS n FROM i GROUP BY page)
SELECT page, CAST(1 AS INTEGER) AS row, CAST(1 AS INTEGER) AS col, '{title}' AS text FROM n UNION ALL SELECT page, 2, 1, 'Part' FROM n UNION ALL SELECT page, 2, 2, 'Status' FROM n
UNION ALL SELECT page, CAST(3 + nth AS INTEGER), 1, 'part ' || l_partkey FROM i
UNION ALL SELECT page, CAST(3 + nth AS INTEGER), 2, CASE WHEN l_suppkey % 3 = 0 THEN 'unlinked' ELSE 'linked' END FROM i
UNION ALL SELECT page, CAST(4 + n AS INTEGER), 1, 'Sum' FROM n UNION ALL SELECT page, CAST(4 + n AS INTEGER), 2, '=SUM(B3:B' || (2 + n) || ')' FROM n"""
)
def q_export_grid(spark, sf_dir):
    """An order's sheet: the template's child row once for each line item, the rows below moved down."""
    template = spark.createDataFrame(TEMPLATE, "row int, col int, text string")
    first = export.first_child_row(template).first()["first"]
    order = ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate"]
    link = F.when(F.col("l_suppkey") % 3 == 0, "redlink").otherwise("x")
    name = F.concat(F.lit("part "), F.col("l_partkey").cast("string"))
    children = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"),
        F.struct(*order).alias("ord"),
        F.array(
            F.struct(name.alias("text"), link.alias("link")), F.struct(F.lit("").alias("text"), F.lit(None).cast("string").alias("link"))
        ).alias("cells"),
    )
    return export.grid(template, children, first).select("page", "row", "col", "text")


LINKED = [
    (1, 1, "Sheet of {title}"), (2, 1, "Part"), (2, 2, "Price"), (3, 1, "{child[0]:linked}"), (3, 2, "{child[1]}"), (3, 3, "{child[0]:doc_link}"),
    (3, 4, "see {child:sheetname}"), (3, 5, "=B3*$C$1"), (3, 6, "{empty}"), (4, 2, "=SUM(__COL__)"),
]


@query(
    """WITH i AS (SELECT l_orderkey AS page, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) - 1 AS nth FROM lineitem),
n AS (SELECT page, count(*) AS n FROM i GROUP BY page), r AS (SELECT *, CAST(3 + nth AS INTEGER) AS row FROM i)
SELECT page, CAST(1 AS INTEGER) AS row, CAST(1 AS INTEGER) AS col, 'Sheet of order ' || page AS text, CAST(NULL AS VARCHAR) AS link, CAST(NULL AS VARCHAR) AS style FROM n
UNION ALL SELECT page, 2, 1, 'Part', NULL, NULL FROM n UNION ALL SELECT page, 2, 2, 'Price', NULL, NULL FROM n
UNION ALL SELECT page, row, 1, 'part ' || l_partkey, CASE WHEN l_suppkey % 3 <> 0 THEN 'https://x.org/p' || l_partkey END, CASE WHEN l_suppkey % 3 = 0 THEN 'unlinked' ELSE 'linked' END FROM r
UNION ALL SELECT page, row, 2, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), NULL, CASE WHEN l_suppkey % 2 = 0 THEN 'changed' END FROM r
UNION ALL SELECT page, row, 3, 'part ' || l_partkey, 'https://x.org/d' || l_suppkey, 'linked' FROM r
UNION ALL SELECT page, row, 4, 'see F ' || page || '-part ' || l_partkey, NULL, NULL FROM r
UNION ALL SELECT page, row, 5, '=B' || row || '*$C$1', NULL, NULL FROM r UNION ALL SELECT page, row, 6, '', NULL, NULL FROM r
UNION ALL SELECT page, CAST(4 + n AS INTEGER), 2, '=SUM(B3:B' || (2 + n) || ')', NULL, NULL FROM n"""
)
def q_export_links(spark, sf_dir):
    """An order's sheet with links, styles of changed cells, names of sheets, and formulas that are copied down."""
    template = spark.createDataFrame(LINKED, "row int, col int, text string")
    order = ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate"]
    part, supplier = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    none = F.lit(None).cast("string")
    red = F.when(F.col("l_suppkey") % 3 == 0, F.lit("&redlink=1")).otherwise("")
    cells = F.array(
        F.struct(F.concat(F.lit("part "), part).alias("text"), F.concat(F.lit("/p"), part, red).alias("link"), none.alias("edit")),
        F.struct(
            F.col("l_quantity").cast("int").cast("string").alias("text"), F.concat(F.lit("/d"), supplier).alias("link"), F.when(F.col("l_suppkey") % 2 == 0, "changed").alias("edit")
        ),
    )
    items = table(spark, sf_dir, "lineitem")
    children = items.select(F.col("l_orderkey").alias("page"), F.struct(*order).alias("ord"), cells.alias("cells"))
    number = F.col("page").cast("string")
    pages = children.select("page").distinct().select(
        "page", F.lit("fond").alias("kind"), number.alias("id"), F.lit("F").alias("parent"), F.create_map(F.lit("title"), F.concat(F.lit("order "), number)).alias("fields")
    )
    return export.grid(template, children, export.first_child_row(template).first()["first"], pages, "https://x.org")


FULL = [
    (1, 1, "{title:linked}"), (1, 2, "{lastmod:date}"), (1, 3, "{parent.id} / {id} {unknown.name}"), (2, 1, "Part & number"),
    (3, 1, "{child[ID]:linked}"), (3, 2, "{child[0]}{child[QTY]}"), (3, 3, "{title}: {child:sheetname}"), (3, 4, "once {id}"), (3, 5, "{child[NOTE]}{empty}"),
    (3, 6, "{child[GONE]}"), (3, 7, "=B3*2"), (4, 1, "{edit:changed}"), (5, 1, "{edit:linked}"), (5, 2, "=SUM(__COL__)"), (6, 1, "end of {title}"),
]


@query(
    """WITH i AS (SELECT l_orderkey AS page, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) - 1 AS nth FROM lineitem),
n AS (SELECT page, count(*) AS n, o_custkey AS c, strftime(o_orderdate, '%d %b %Y') AS d FROM i JOIN orders ON o_orderkey = page GROUP BY ALL), r AS (SELECT i.*, c, CAST(3 + nth AS INTEGER) AS row FROM i JOIN n USING (page))
SELECT page, CAST(1 AS INTEGER) AS row, CAST(1 AS INTEGER) AS col, 'A & B <' || page || '>' AS text, 'https://x.org/o' || page AS link, 'linked' AS style FROM n
UNION ALL SELECT page, 1, 2, d, NULL, NULL FROM n UNION ALL SELECT page, 1, 3, 'c' || c || ' / ' || page || ' {unknown.name}', NULL, NULL FROM n
UNION ALL SELECT page, 2, 1, 'Part & number', NULL, NULL FROM n
UNION ALL SELECT page, row, 1, 'part "' || l_partkey || '"', CASE WHEN l_suppkey % 3 <> 0 THEN 'https://x.org/p' || l_partkey END, CASE WHEN l_suppkey % 3 = 0 THEN 'unlinked' ELSE 'linked' END FROM r
UNION ALL SELECT page, row, 2, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), NULL, CASE WHEN l_suppkey % 2 = 0 THEN 'changed' END FROM r
UNION ALL SELECT page, row, 3, 'A & B <' || page || '>: Fund part "' || l_partkey || '"', NULL, NULL FROM r
UNION ALL SELECT page, row, 4, 'once ' || page, NULL, NULL FROM r WHERE nth = 0
UNION ALL SELECT page, row, 5, '', NULL, NULL FROM r UNION ALL SELECT page, row, 6, '', NULL, NULL FROM r UNION ALL SELECT page, row, 7, '=B' || row || '*2', NULL, NULL FROM r
UNION ALL SELECT page, CAST(4 + n AS INTEGER), 1, '{edit:changed}', NULL, 'changed' FROM n UNION ALL SELECT page, CAST(5 + n AS INTEGER), 1, '{edit:linked}', NULL, 'linked' FROM n
UNION ALL SELECT page, CAST(5 + n AS INTEGER), 2, '=SUM(B3:B' || (2 + n) || ')', NULL, NULL FROM n UNION ALL SELECT page, CAST(6 + n AS INTEGER), 1, 'end of A & B <' || page || '>', NULL, NULL FROM n"""
)
def q_export_template(spark, sf_dir):
    """A sheet of each order by a template that uses all there is: labels, several tokens, dotted names, dates, prototypes."""
    template = spark.createDataFrame(FULL, "row int, col int, text string")
    order = ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate"]
    part = F.col("l_partkey").cast("string")
    none = F.lit(None).cast("string")
    red = F.when(F.col("l_suppkey") % 3 == 0, F.lit("&redlink=1")).otherwise("")
    cells = F.array(
        F.struct(F.concat(F.lit("part &quot;"), part, F.lit("&#34;")).alias("text"), F.concat(F.lit("/p"), part, red).alias("link"), none.alias("edit")),
        F.struct(F.col("l_quantity").cast("int").cast("string").alias("text"), none.alias("link"), F.when(F.col("l_suppkey") % 2 == 0, "changed").alias("edit")),
    )
    children = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.struct(*order).alias("ord"), cells.alias("cells"))
    number = F.col("o_orderkey").cast("string")
    fields = {
        "title": F.concat(F.lit("A &amp; B &lt;"), number, F.lit("&gt;")), "id": number, "url": F.concat(F.lit("https://x.org/o"), number),
        "lastmod": standard(F.col("o_orderdate")), "parent.id": F.concat(F.lit("c"), F.col("o_custkey").cast("string")),
    }
    pages = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("page"), F.lit("archive").alias("kind"), number.alias("id"), none.alias("parent"),
        F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]).alias("fields"),
        F.create_map(F.lit("ID"), F.lit(0), F.lit("QTY"), F.lit(1), F.lit("NOTE"), F.lit(7)).alias("header"),
    )
    return export.grid(template, children, export.first_child_row(template).first()["first"], pages, "https://x.org")


@query(
    """WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS page, o_orderkey, o_orderstatus, CAST(2 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS row, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT page, row, CAST(1 AS INTEGER) AS col, 'order <' || o_orderkey || '>' AS text, CASE WHEN o_orderkey % 3 <> 0 THEN 'https://x.org/o?a=1&b=' || o_orderkey END AS link, CASE WHEN o_orderkey % 3 = 0 THEN 'unlinked' ELSE 'linked' END AS style FROM o
UNION ALL SELECT page, row, 2, o_orderstatus, NULL, CASE WHEN o_orderkey % 2 = 0 THEN 'changed' END FROM o
UNION ALL SELECT DISTINCT page, 1, 1, 'Customer ' || page, NULL, NULL FROM o UNION ALL SELECT DISTINCT page, CAST(4 + n AS INTEGER), 2, '=COUNTA(B3:B' || (2 + n) || ')', NULL, NULL FROM o"""
)
def q_workbooks(spark, sf_dir):
    """A workbook for each customer, written as files and read back: texts, links, styles and formulas."""
    template = spark.createDataFrame([(1, 1, "Customer {id}"), (3, 1, "{child[0]:linked}"), (3, 2, "{child[1]}"), (4, 2, "=COUNTA(__COL__)")], "row int, col int, text string")
    number = F.col("o_orderkey").cast("string")
    none = F.lit(None).cast("string")
    red = F.when(F.col("o_orderkey") % 3 == 0, F.lit("&redlink=1")).otherwise("")
    cells = F.array(
        F.struct(F.concat(F.lit("order <"), number, F.lit(">")).alias("text"), F.concat(F.lit("/o?a=1&b="), number, red).alias("link"), none.alias("edit")),
        F.struct(F.col("o_orderstatus").alias("text"), none.alias("link"), F.when(F.col("o_orderkey") % 2 == 0, "changed").alias("edit")),
    )
    orders = table(spark, sf_dir, "orders")
    children = orders.select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("ord"), cells.alias("cells"))
    pages = orders.select(F.col("o_custkey").alias("page")).distinct().withColumn("fields", F.create_map(F.lit("id"), F.col("page").cast("string")))
    folder = f"{scratch_folder(spark)}/workbooks"
    write_workbooks(export.grid(template, children, export.first_child_row(template).first()["first"], pages, "https://x.org"), folder)
    return read_workbooks(spark, folder)


@query("SELECT l_orderkey, '=SUM(A3:A' || (2 + count(*)) || ')' AS formula FROM lineitem GROUP BY l_orderkey")
def q_export_formula(spark, sf_dir):
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return sizes.select("l_orderkey", export.fill_formula(F.lit("=SUM(__COL__)"), F.lit("A"), F.lit(3), F.col("n")).alias("formula"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Fund ' || o_custkey WHEN 1 THEN o_orderstatus || ' ' || o_orderkey || '-' || o_custkey ELSE 'sheetname-' || o_custkey END AS sheet,
'x' || strftime(o_orderdate, '%Y,%m,%d') AS day FROM orders"""
)
def q_export_sheetname(spark, sf_dir):
    from ..functions.timefmt import day

    kind = F.get(F.array(F.lit("archive"), F.lit("fond"), F.lit("opus")), (F.col("o_orderkey") % 3).cast("int"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        export.sheet_name(kind, *[F.col(c).cast("string") for c in ("o_custkey", "o_orderkey", "o_orderstatus")]).alias("sheet"),
        F.concat(F.lit("x"), day(standard(F.col("o_orderdate")))).alias("day"),
    )


@query(
    """SELECT p_partkey, 'child' AS name, CAST(p_size AS VARCHAR) AS index, CASE WHEN p_size % 2 = 0 THEN 'date' ELSE '' END AS modifier FROM part"""
)
def q_template_tokens(spark, sf_dir):
    """Tokens of template cells."""
    cell = F.concat(F.lit("see {child["), F.col("p_size").cast("string"), F.lit("]"), F.when(F.col("p_size") % 2 == 0, ":date").otherwise(""), F.lit("}."))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(export.tokens(cell)).alias("t")).select("p_partkey", "t.*")


@query(
    """SELECT event_id, last_value(CASE WHEN event_id % 4 = 1 THEN 'l' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS link FROM events"""
)
def q_prop_last_link(spark, sf_dir):
    """The last link of a row in all its cells."""
    from ..operators.ops import last_link

    link = F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("l"), F.col("event_id").cast("string")))
    cells = table(spark, sf_dir, "events").select(F.col("user_id").alias("row"), F.col("event_id").alias("col"), link.alias("link"))
    return last_link(cells).select(F.col("col").alias("event_id"), "link")


