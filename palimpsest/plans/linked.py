"""Links of pages: targets, classes, extraction, differences, existence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import links
from ..operators import enrich
from .registry import query, table

ANCHORS = r"""a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"[^>]*>', 1)) AS href FROM pages)"""


def anchors(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.posexplode(links.hrefs(F.col("html"))).alias("pos", "a"))
    return pages.select("page_id", "pos", "a.href", "a.text")


@query(f"WITH {ANCHORS} SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_targets, min(href) AS first_target FROM a GROUP BY page_id")
def q_page_links(spark, sf_dir):
    return anchors(spark, sf_dir).groupBy("page_id").agg(
        F.count("*").alias("n_links"), F.countDistinct("href").alias("n_targets"), F.min("href").alias("first_target")
    )


@query(
    r"""SELECT page_id, coalesce(TRY_CAST(nullif(regexp_extract(replace(url, 'page=', 'oldid='), 'oldid=([0-9]+)', 1), '') AS BIGINT), 0) AS oldid,
CASE WHEN page_id % 3 = 0 THEN 'unlinked' WHEN url = '' THEN 'unlinked' ELSE 'linked' END AS status FROM pages"""
)
def q_oldid_extract(spark, sf_dir):
    """Versions that addresses ask for, and whether links lead anywhere."""
    url = F.replace("url", F.lit("page="), F.lit("oldid="))
    link = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("&redlink=1"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", links.old_id(url).alias("oldid"), links.link_status(link).alias("status"))


@query(
    """SELECT page_id, replace(url_decode(replace(replace('https://x.org/wiki/' || regexp_extract(url, '[a-z]+/[0-9]+') || '%20a%2Fb', 'https://x.org', ''), '/wiki/', '')), '+', ' ') AS title FROM pages"""
)
def q_url_title(spark, sf_dir):
    url = F.concat(F.lit("https://x.org/wiki/"), F.regexp_extract("url", "[a-z]+/[0-9]+", 0), F.lit("%20a%2Fb"))
    return table(spark, sf_dir, "pages").select("page_id", links.title_of(url, "https://x.org").alias("title"))


@query(
    f"""WITH {ANCHORS} SELECT page_id, href, 'https://x.org/wiki/' || CASE length(href) % 4 WHEN 0 THEN 'A/B/C' || href WHEN 1 THEN 'A/B' || href WHEN 2 THEN 'A/B/C' || href ELSE substr(href, 2) END AS target
FROM (SELECT page_id, rtrim(replace(href, ' ', '_'), '/') AS href FROM a WHERE href LIKE '/_%' AND href NOT LIKE '%//%' AND trim(href, '/') <> '')"""
)
def q_expand_link(spark, sf_dir):
    """Links of pages as targets of all kinds, seen from the page A/B/C."""
    a = anchors(spark, sf_dir).where((F.length("href") > 1) & F.startswith("href", F.lit("/")) & ~F.contains("href", F.lit("//")) & (F.btrim("href", F.lit("/")) != ""))
    a = a.select("page_id", F.regexp_replace(F.replace("href", F.lit(" "), F.lit("_")), "/+$", "").alias("href"))
    k, rest = F.length("href") % 4, F.expr("substring(href, 2)")
    target = (
        F.when(k == 0, F.concat(F.col("href"), F.lit("/")))
        .when(k == 1, F.concat(F.lit(" ..//"), rest))
        .when(k == 2, F.concat(F.lit("./"), rest, F.lit("// ")))
        .otherwise(rest)
    )
    return a.select("page_id", "href", links.expand_target(target, F.lit("A/B/C"), "https://x.org").alias("target"))


@query(
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://commons.wikimedia.org/wiki/File_' || page_id END AS commons,
CASE WHEN page_id % 3 = 0 THEN '/wiki/File:a_b_' || page_id END AS file, 'Ns:' || page_id AS title FROM pages"""
)
def q_commons_map(spark, sf_dir):
    """Addresses of shared files and of local ones, and titles with a namespace."""
    number = F.col("page_id").cast("string")
    shared = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("C:File "), number)).otherwise(number)
    local = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("file:a b "), number)).otherwise(number)
    return table(spark, sf_dir, "pages").select(
        "page_id", links.commons_url(shared).alias("commons"), links.file_url(local).alias("file"), links.with_namespace(number, "Ns").alias("title")
    )


@query(
    f"""WITH {ANCHORS} SELECT page_id, count(*) FILTER (href LIKE '/t%') AS first_class, count(*) FILTER (href NOT LIKE '/t%' AND length(href) > 6) AS second_class,
count(*) FILTER (href NOT LIKE '/t%' AND length(href) <= 6) AS rest FROM a GROUP BY page_id"""
)
def q_link_classes(spark, sf_dir):
    """Links by the first condition that they meet."""
    number = links.first_match(F.startswith("href", F.lit("/t")), F.length("href") > 6)
    parted = anchors(spark, sf_dir).withColumn("c", number)
    count = lambda i, name: F.count(F.when(F.col("c") == i, 1)).alias(name)
    return parted.groupBy("page_id").agg(count(0, "first_class"), count(1, "second_class"), count(2, "rest"))


@query(f"WITH {ANCHORS}, d AS (SELECT DISTINCT page_id, href FROM a) SELECT page_id, string_agg(href, ' ' ORDER BY href) AS targets FROM d GROUP BY page_id")
def q_links_dedupe(spark, sf_dir):
    """Each page's targets once."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.transform(links.hrefs(F.col("html")), lambda a: a["href"]).alias("h"))
    once = F.array_sort(F.array_distinct("h"))
    return pages.where(F.size("h") > 0).select("page_id", F.array_join(once, " ").alias("targets"))


@query(
    f"""WITH {ANCHORS}, n AS (SELECT page_id, href, row_number() OVER (PARTITION BY page_id, href) AS nth FROM a)
SELECT page_id, href, count(*) AS times FROM n WHERE nth > CASE WHEN href IN ('/the', '/of') THEN 1 ELSE 0 END GROUP BY page_id, href"""
)
def q_links_subtract(spark, sf_dir):
    """Each page's links less one /the and one /of."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.transform(links.hrefs(F.col("html")), lambda a: a["href"]).alias("h"))
    minus = F.array(F.lit("/the"), F.lit("/of"), F.lit("absent"))
    left = pages.select("page_id", F.explode(links.subtract_links(F.col("h"), minus)).alias("href"))
    return left.groupBy("page_id", "href").agg(F.count("*").alias("times"))


@query(
    f"""WITH {ANCHORS}, t AS (SELECT DISTINCT href AS title FROM a), k AS (SELECT title, length(title) % 2 = 0 AS exists FROM t WHERE length(title) > 4)
SELECT page_id, href AS title, coalesce(k.exists, TRUE) AS exists FROM a LEFT JOIN k ON k.title = a.href"""
)
def q_exists_join(spark, sf_dir):
    """Whether targets exist, true where nothing is known."""
    a = anchors(spark, sf_dir).select("page_id", F.col("href").alias("title"))
    known = a.select("title").distinct().where(F.length("title") > 4).withColumn("exists", F.length("title") % 2 == 0)
    return enrich.exists(a, known).select("page_id", "title", "exists")


@query(
    f"""WITH {ANCHORS}, f AS (SELECT page_id, min(href) AS file FROM a GROUP BY page_id)
SELECT pages.page_id, CASE WHEN pages.page_id % 2 = 0 AND pages.page_id % 5 <> 0 THEN coalesce(file, 'redlink') WHEN pages.page_id % 5 = 0 THEN 'own' ELSE 'redlink' END AS doc_link
FROM pages LEFT JOIN f ON f.page_id = pages.page_id"""
)
def q_doc_link_fill(spark, sf_dir):
    """Rows whose key is linked and whose document isn't get a file of their page."""
    rows = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("title"),
        F.when(F.col("page_id") % 2 == 0, "url").otherwise("").alias("key_link"),
        F.when(F.col("page_id") % 5 == 0, "own").otherwise("redlink").alias("doc_link"),
    )
    files = anchors(spark, sf_dir).select(F.col("page_id").alias("title"), F.col("href").alias("pos"), F.col("href").alias("url"))
    return enrich.fill_document_links(rows, files).select(F.col("title").alias("page_id"), "doc_link")


@query(
    r"""SELECT page_id, trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)) AS raw_title, CAST(0 AS BIGINT) AS n_rows FROM pages"""
)
def q_html_pages(spark, sf_dir):
    """Pages read into nested rows; the test pages have a heading and no table."""
    from ..sources.pages import html_pages

    read = html_pages(table(spark, sf_dir, "pages").select("page_id", "html"))
    return read.select("page_id", F.btrim("title_html", F.lit(" ")).alias("raw_title"), F.size("children").cast("long").alias("n_rows"))
