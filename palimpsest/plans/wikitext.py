"""Wikitext: tables, link classes, files, documents, indexes; and the addresses that a service answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import links
from ..operators import answers
from ..sources.pages import wikitext_pages
from .linked import ANCHORS, anchors
from .registry import query, table

SITE = "https://x.org"
# The pages' links as wikitext of each class, by the length of the target.
CLASSED = f"""{ANCHORS}, c AS (SELECT page_id, trim(regexp_replace(href, '[\\[\\]|]', '', 'g')) AS t FROM a),
k AS (SELECT page_id, t, length(t) % 5 AS k FROM c WHERE t <> '' AND t NOT LIKE '%:%')"""


def wikitexts(spark, sf_dir):
    """(page_id, wikitext): each page's links, one a line, as links of all classes."""
    a = anchors(spark, sf_dir).select("page_id", "pos", F.trim(F.regexp_replace("href", r"[\[\]|]", "")).alias("t")).where("t <> '' AND t NOT LIKE '%:%'")
    k = F.length("t") % 5
    line = (
        F.when(k == 0, F.concat(F.lit("see [[C:"), "t", F.lit("|shared]]")))
        .when(k == 1, F.concat(F.lit("[[Категорія:"), "t", F.lit("]]")))
        .when(k == 2, F.concat(F.lit("* [https://x.org"), "t", F.lit(" out]")))
        .when(k == 3, F.concat(F.lit("[[ "), "t", F.lit(" |own text]]")))
        .otherwise(F.concat(F.lit("[["), "t", F.lit("]], "), "t"))
    )
    lines = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return a.groupBy("page_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("wikitext"))


@query(
    f"""WITH {CLASSED} SELECT page_id, count(*) FILTER (k = 0) AS commons, count(*) FILTER (k = 1) AS category, count(*) FILTER (k >= 3) AS internal, count(*) FILTER (k = 2) AS external,
min('https://commons.wikimedia.org/wiki/' || replace(t, ' ', '_')) FILTER (k = 0) AS first_commons, min(t) FILTER (k >= 3) AS first_internal FROM k GROUP BY page_id"""
)
def q_wikitext_links(spark, sf_dir):
    """Links of wikitexts in four classes."""
    found = wikitexts(spark, sf_dir).select("page_id", links.link_classes(F.col("wikitext")).alias("c"))
    n = lambda name: F.size(f"c.{name}_links").cast("long").alias(name)
    return found.select(
        "page_id", *map(n, ("commons", "category", "internal", "external")),
        F.array_min("c.commons_links").alias("first_commons"), F.array_min("c.internal_links").alias("first_internal"),
    )


@query(
    f"""WITH {CLASSED} SELECT page_id, CAST(2 * count(*) AS BIGINT) AS links, CAST(count(*) AS BIGINT) AS outer_links, min('File:' || t) AS first_outer, min('in/' || t) AS first_inner, count(DISTINCT 'File:' || t || '.png') AS files
FROM k GROUP BY page_id"""
)
def q_nested_wikitext(spark, sf_dir):
    """Links within captions of links, and files behind nested templates, in the texts of pages; comments hide theirs."""
    a = anchors(spark, sf_dir).select("page_id", F.trim(F.regexp_replace("href", r"[\[\]|]", "")).alias("t")).where("t <> '' AND t NOT LIKE '%:%'")
    line = F.concat(
        F.lit("[[File:"), "t", F.lit("|thumb|see [[in/"), "t", F.lit("|x]] <!-- [[hidden]] -->]] {{box|{{inner|a=1}}|f=File:"), "t", F.lit(".png}}")
    )
    texts = a.groupBy("page_id").agg(F.array_join(F.collect_list(line), "\n").alias("w"))
    found = texts.select("page_id", F.transform(links.wikilinks(F.col("w")), lambda x: x["target"]).alias("all"), links.file_links(F.col("w")).alias("f"))
    begin = lambda s: F.filter("all", lambda t: F.startswith(t, F.lit(s)))
    outer, inner = begin("File:"), begin("in/")
    return found.select(
        "page_id", F.size("all").cast("long").alias("links"), F.size(outer).cast("long").alias("outer_links"), F.array_min(outer).alias("first_outer"),
        F.array_min(inner).alias("first_inner"), F.size(F.filter("f", lambda x: x.endswith(".png"))).cast("long").alias("files"),
    )


@query(
    f"""WITH {ANCHORS}, f AS (SELECT DISTINCT page_id, 'File:' || replace(trim(regexp_replace(href, '[^A-Za-z0-9/ ]', '', 'g')), '/', '') AS f FROM a),
g AS (SELECT page_id, f FROM f WHERE f <> 'File:') SELECT page_id, count(*) AS n_files, min(f) AS first_file FROM g GROUP BY page_id"""
)
def q_file_links(spark, sf_dir):
    """Files that wikitexts name: as links, in templates, by address."""
    a = anchors(spark, sf_dir).select("page_id", F.replace(F.trim(F.regexp_replace("href", "[^A-Za-z0-9/ ]", "")), F.lit("/"), F.lit("")).alias("f")).where("f <> ''")
    k = F.length("f") % 3
    mark = (
        F.when(k == 0, F.concat(F.lit("[[File:"), "f", F.lit("|thumb]]")))
        .when(k == 1, F.concat(F.lit("{{box|image=File:"), "f", F.lit("}}")))
        .otherwise(F.concat(F.lit("{{box|at=https://x.org/wiki/File:"), F.replace("f", F.lit(" "), F.lit("_")), F.lit("}}")))
    )
    texts = a.groupBy("page_id").agg(F.array_join(F.collect_list(mark), " ").alias("w"))
    files = texts.select("page_id", links.file_links(F.col("w")).alias("f"))
    return files.select("page_id", F.size("f").cast("long").alias("n_files"), F.array_min("f").alias("first_file"))


@query(
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://x.org/wiki/A/' || page_id || '/' || page_id WHEN 1 THEN 'https://commons.wikimedia.org/wiki/File_' || page_id END AS document FROM pages"""
)
def q_document_url(spark, sf_dir):
    """A page's document: its first internal link, else a shared file of its notes, else nothing."""
    k, number = F.col("page_id") % 3, F.col("page_id").cast("string")
    body = F.when(k == 0, F.concat(F.lit("[[C:other]] [[/"), number, F.lit("/]]"))).otherwise("[[Категорія:x]]")
    notes = F.when(k == 1, F.concat(F.lit("in [[c:File "), number, F.lit("]]"))).otherwise("none")
    url = links.document_url(links.link_classes(body), links.link_classes(notes), F.concat(F.lit("A/"), number), SITE)
    return table(spark, sf_dir, "pages").select("page_id", url.alias("document"))


@query(
    """WITH n AS (SELECT r_regionkey, r_name, n_nationkey, n_name FROM region JOIN nation ON n_regionkey = r_regionkey)
SELECT r_regionkey, 'Архіви/' || r_name AS template, r_name AS description, '19' || r_regionkey || '0' AS dates, CAST(count(*) AS BIGINT) AS n_rows, 'No,Name' AS header,
string_agg(n_nationkey || '=' || n_name || '@' || CASE WHEN n_nationkey % 2 = 0 THEN '/' || n_name ELSE '' END, ' ' ORDER BY n_nationkey) AS rows FROM n GROUP BY ALL"""
)
def q_wikitext_pages(spark, sf_dir):
    """A region's page of wikitext, read: its describing template and its table of nations."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    name = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("[[/"), "n_name", F.lit("|"), "n_name", F.lit("]]"))).otherwise(F.concat(F.lit("'''"), "n_name", F.lit("'''")))
    row = F.concat(F.lit("|-\n| "), F.col("n_nationkey").cast("string"), F.lit(" || "), name)
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x["r"]), "\n")
    year = F.concat(F.lit("19"), F.col("r_regionkey").cast("string"), F.lit("0"))
    pages = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(rows.alias("rows"))
    text = F.concat(
        F.lit("{{Архіви/"), "r_name", F.lit("\n| назва = "), "r_name", F.lit("\n| рік = "), year, F.lit("\n}}\n{| class=\"wikitable\"\n! No !! Name\n"), "rows", F.lit("\n|}\n")
    )
    read = wikitext_pages(pages.select("r_regionkey", text.alias("wikitext")))
    cell = lambda c: F.concat(c[0]["text"], F.lit("="), c[1]["text"], F.lit("@"), F.coalesce(c[1]["link"], F.lit("")))
    return read.select(
        "r_regionkey", "template", "description", "dates", F.size("children").cast("long").alias("n_rows"), F.array_join(F.transform("header", F.trim), ",").alias("header"),
        F.array_join(F.transform("children", cell), " ").alias("rows"),
    )


@query(
    f"""WITH {CLASSED} SELECT page_id, 'Архів:' || t AS link, CASE WHEN k < 3 THEN 'about ' || t ELSE 'Архів:' || t END AS description, count(*) AS n FROM k GROUP BY ALL"""
)
def q_archive_index(spark, sf_dir):
    """An index's links of one namespace with their descriptions, the target where there is none."""
    a = anchors(spark, sf_dir).select("page_id", F.trim(F.regexp_replace("href", r"[\[\]|]", "")).alias("t")).where("t <> '' AND t NOT LIKE '%:%'")
    described = F.when(F.length("t") % 5 < 3, F.concat(F.lit("|about "), "t")).otherwise("")
    line = F.concat(F.lit("* [[Архів:"), "t", described, F.lit("]] and [["), "t", F.lit("]]"))
    texts = a.groupBy("page_id").agg(F.array_join(F.collect_list(line), "\n").alias("w"))
    found = texts.select("page_id", F.explode(links.wikilinks(F.col("w"))).alias("l")).where(F.startswith("l.target", F.lit("Архів:")))
    shown = F.coalesce(F.nullif(F.trim("l.text"), F.lit("")), F.col("l.target"))
    return found.groupBy("page_id", F.col("l.target").alias("link"), shown.alias("description")).agg(F.count("*").alias("n"))


@query(
    """SELECT r_name AS archive, n_name AS subarchive, max('/wiki/' || r_name || '/' || n_name) AS link FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 < 2 GROUP BY ALL"""
)
def q_subarchive_sniff(spark, sf_dir):
    """Sub-archives among the anchors of regions' pages: the last link of each, none that are unwritten or deeper."""
    regions = table(spark, sf_dir, "region")
    nations = table(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey") % 4
    title = F.concat("r_name", F.lit("/"), "n_name", F.when(k == 2, F.lit("/1")).otherwise(""))
    href = F.concat(F.lit("/wiki/"), title, F.when(k == 3, F.lit("&redlink=1")).otherwise(""))
    found = nations.select(F.col("r_name").alias("archive"), title.alias("title"), href.alias("href"))
    found = found.unionByName(regions.select(F.col("r_name").alias("archive"), F.concat("r_name", F.lit("/видання")).alias("title"), F.lit("/wiki/v").alias("href")))
    sniffed = found.withColumn("subarchive", links.subarchive(F.col("title"), F.col("href"), F.col("archive")))
    return sniffed.where("subarchive IS NOT NULL").groupBy("archive", "subarchive").agg(F.max("href").alias("link"))


@query(
    """WITH t AS (SELECT page_id, regexp_extract(url, '[a-z]+/[0-9]+$') || ' é~*' AS title, replace(regexp_extract(url, '[a-z]+/[0-9]+$'), ' ', '%20') || '%20%C3%A9~%2A' AS q FROM pages)
SELECT page_id, 'https://x.org/w/api.php?action=query&format=json&prop=revisions&rvprop=ids|timestamp&rvlimit=5&titles=' || q AS history,
'https://x.org/w/index.php?title=' || q || '&oldid=' || page_id AS revision,
'https://x.org/w/api.php?action=query&format=json&prop=revisions&rvprop=content&rvslots=main&titles=' || q || '|a%3Ab' AS content FROM t"""
)
def q_api_urls(spark, sf_dir):
    """Addresses that ask for histories, revisions and texts; titles are encoded but for slashes."""
    title = F.concat(F.regexp_extract("url", "[a-z]+/[0-9]+$", 0), F.lit(" é~*"))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        links.history_url(title, SITE, 5).alias("history"),
        links.revision_url(title, F.col("page_id"), SITE).alias("revision"),
        links.content_url(F.array(title, F.lit("a:b")), SITE).alias("content"),
    )


def told_pages(spark, sf_dir):
    """(page_id, asked, title, key, page): pages as a service tells of them. Every third is asked for by a name that is
    written otherwise, every fifth by one that leads elsewhere, and some are missing or no titles at all."""
    n = F.col("page_id")
    title = F.concat(F.lit("Архів:P/"), n.cast("string"))
    text = F.concat(F.lit("{{t|f=File:"), n.cast("string"), F.lit(" a.pdf}} [[File:b.png]] [[x]]"))
    revision = F.struct(n.alias("revid"), F.lit("2024-03-01T10:15:30Z").alias("timestamp"), F.struct(F.struct(text.alias("*")).alias("main")).alias("slots"))
    page = F.struct(
        title.alias("title"), F.when(n % 7 == 0, "").alias("missing"), F.when(n % 11 == 0, "").alias("invalid"),
        F.when((n % 7 != 0) & (n % 11 != 0), F.array(revision)).alias("revisions"),
    )
    asked = F.when(n % 3 == 0, F.concat(F.lit("архів:p/"), n.cast("string"))).when(n % 5 == 0, F.concat(F.lit("Old/"), n.cast("string"))).otherwise(title)
    key = F.when(n % 7 == 0, -n).otherwise(n).cast("string")
    return table(spark, sf_dir, "pages").select("page_id", asked.alias("asked"), title.alias("title"), key.alias("key"), page.alias("page"))


def told_answers(spark, sf_dir):
    """(titles, body): an answer for every twenty pages."""
    told = told_pages(spark, sf_dir)
    n = F.col("page_id")
    middle = F.concat(F.lit("Middle/"), n.cast("string"))
    other = lambda a, b: F.struct(a.alias("from"), b.alias("to"))
    grouped = told.groupBy(F.floor(n / 20).alias("batch")).agg(
        F.collect_list("asked").alias("titles"),
        F.array_compact(F.collect_list(F.when(n % 3 == 0, other(F.col("asked"), F.col("title"))))).alias("normalized"),
        F.flatten(F.collect_list(F.when((n % 3 != 0) & (n % 5 == 0), F.array(other(middle, F.col("title")), other(F.col("asked"), middle))))).alias("redirects"),
        F.map_from_entries(F.collect_list(F.struct("key", "page"))).alias("pages"),
    )
    return grouped.select("titles", F.to_json(F.struct(F.struct("normalized", "redirects", "pages").alias("query"))).alias("body"))


ASKED = """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'архів:p/' || page_id WHEN page_id % 5 = 0 THEN 'Old/' || page_id ELSE 'Архів:P/' || page_id END AS title, page_id % 7 <> 0 AND page_id % 11 <> 0 AS fine FROM pages"""


@query(f'SELECT title, fine AS "exists" FROM ({ASKED})')
def q_answers_existence(spark, sf_dir):
    """Which of the titles that were asked for have a page, by whatever name it is now."""
    return answers.existence(told_answers(spark, sf_dir))


@query(f"""SELECT 'P/' || page_id AS title, CASE WHEN fine THEN '/wiki/File:b.png /wiki/File:' || page_id || '_a.pdf' ELSE '' END AS links FROM ({ASKED})""")
def q_answers_documents(spark, sf_dir):
    """Addresses of the files that pages' texts name."""
    return answers.documents(told_answers(spark, sf_dir)).select("title", F.array_join("links", " ").alias("links"))


@query(f"""SELECT 'Архів:P/' || page_id AS title, page_id AS revid, '2024,03,01,10:15' AS modified FROM ({ASKED}) WHERE fine""")
def q_answers_histories(spark, sf_dir):
    return answers.histories(told_answers(spark, sf_dir))


@query(
    """SELECT page_id, CASE WHEN page_id % 4 < 3 THEN 'P/' || page_id END AS title, CASE WHEN page_id % 4 < 3 THEN page_id END AS revid, CASE WHEN page_id % 4 < 3 THEN url END AS wikitext,
CASE page_id % 8 WHEN 3 THEN 'no such page' WHEN 7 THEN 'no answer' END AS error FROM pages"""
)
def q_answers_contents(spark, sf_dir):
    """Texts of pages by an answer each; errors and what is no answer are told."""
    n = F.col("page_id")
    parse = F.struct(F.concat(F.lit("Архів:P/"), n.cast("string")).alias("title"), n.alias("revid"), F.struct(F.col("url").alias("*")).alias("wikitext"))
    body = F.when(n % 4 < 3, F.to_json(F.struct(parse.alias("parse")))).when(n % 8 == 3, '{"error":{"code":"missing","info":"no such page"}}').otherwise("<html>")
    return answers.contents(table(spark, sf_dir, "pages").select("page_id", body.alias("body")))
