"""Feeds, addresses and trees over the order hierarchy region, nation, customer, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import links, text
from ..functions.timefmt import since, standard
from ..operators import tree, watch
from .registry import query, table

CUTOFF = "1998,06"
PARTS = ["archive", "fond", "opus", "case"]

HIERARCHY = """h AS (SELECT r_name AS archive, '_' AS subarchive, n_name AS fond, CAST(c_custkey AS VARCHAR) AS opus,
 CAST(o_orderkey AS VARCHAR) AS kase, o_orderkey, o_orderstatus, o_orderdate AS ts
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """archive, subarchive, fond, opus, case, o_orderkey, o_orderstatus, ts of each order. Spark broadcasts the small sides
    by their sizes."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    joined = joined.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        F.col("r_name").alias("archive"),
        F.lit("_").alias("subarchive"),
        F.col("n_name").alias("fond"),
        F.col("c_custkey").cast("string").alias("opus"),
        F.col("o_orderkey").cast("string").alias("case"),
        "o_orderkey",
        "o_orderstatus",
        F.col("o_orderdate").alias("ts"),
    )


@query(
    f"""WITH {HIERARCHY}, a AS (SELECT *, unnest(range(0, 4)) AS lvl FROM h WHERE ts >= TIMESTAMP '1998-06-01'),
p AS (SELECT archive, CASE WHEN lvl >= 1 THEN fond ELSE '' END AS fond, CASE WHEN lvl >= 2 THEN opus ELSE '' END AS opus,
 CASE WHEN lvl >= 3 THEN kase ELSE '' END AS kase, lvl, ts FROM a)
SELECT archive || ',_,' || fond || ',' || opus || ',' || kase AS address,
 rtrim(archive || '/' || fond || '/' || opus || '/' || kase, '/') AS path, CAST(lvl AS INTEGER) AS level,
 strftime(max(ts), '%Y,%m,%d,%H:%M') AS modified FROM p GROUP BY archive, fond, opus, kase, lvl"""
)
def q_feed_summary(spark, sf_dir):
    """Which addresses, ancestors included, changed since the cut-off, and when last."""
    feed = hierarchy(spark, sf_dir).where(since(F.col("ts"), CUTOFF))
    rolled = tree.with_ancestors(feed, PARTS)
    newest = watch.summary(rolled, CUTOFF, ["archive", "subarchive", "fond", "opus", "case", "level"])
    return newest.select(
        links.address_key(*[F.col(c) for c in links.ADDRESS]).alias("address"),
        links.page_path(*[F.col(c) for c in PARTS]).alias("path"),
        "level",
        standard(F.col("ts")).alias("modified"),
    )


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y,%m,%d,%H:%M') AS modified FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-06-01' AND EXISTS (SELECT 1 FROM customer JOIN nation ON c_nationkey = n_nationkey
 WHERE c_custkey = o_custkey AND n_regionkey = 1)"""
)
def q_feed_membership(spark, sf_dir):
    """The feed's entries that belong to one archive."""
    nations = table(spark, sf_dir, "nation").where("n_regionkey = 1")
    members = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    feed = table(spark, sf_dir, "orders").where(since(F.col("o_orderdate"), CUTOFF))
    feed = feed.join(members, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return feed.select("o_orderkey", standard(F.col("o_orderdate")).alias("modified"))


@query("SELECT o_orderkey, o_orderdate AS ts FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def q_feed_page_k(spark, sf_dir):
    feed = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"))
    return watch.page_of_feed(feed, 50, 100, "o_orderkey")


@query(
    f"""WITH {HIERARCHY}, l AS (SELECT archive || ',' || subarchive || ',' || fond || ',,' AS address, ts FROM h
UNION ALL SELECT archive || ',' || subarchive || ',,,', ts FROM h)
SELECT address, strftime(max(ts), '%Y,%m,%d,%H:%M') AS modified FROM l GROUP BY address"""
)
def q_feed_merge_ancestors(spark, sf_dir):
    """Changes of fonds and of archives in one table, the newest of each address."""
    h = hierarchy(spark, sf_dir)
    none = F.lit("")
    fonds = h.select(links.address_key(F.col("archive"), F.col("subarchive"), F.col("fond"), none, none).alias("address"), "ts")
    tops = h.select(links.address_key(F.col("archive"), F.col("subarchive"), none, none, none).alias("address"), "ts")
    return watch.merge_newest(fonds, tops, ["address"], "ts").select("address", standard(F.col("ts")).alias("modified"))


@query("SELECT strftime(greatest(max(ts), TIMESTAMP '2024-01-15'), '%Y,%m,%d,%H:%M') AS last_checked FROM events WHERE event_type = 'view'")
def q_watermark_advance(spark, sf_dir):
    views = table(spark, sf_dir, "events").where("event_type = 'view'")
    last = watch.watermark(views, "ts", F.lit("2024-01-15").cast("timestamp_ntz"))
    return last.select(standard(F.col("last_checked")).alias("last_checked"))


def archives(spark, sf_dir):
    """tag, sub_key, en, ord of a list of archives: regions and their nations."""
    regions, nations = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    return nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("tag"),
        F.col("n_name").alias("sub_key"),
        F.upper("n_name").alias("en"),
        F.col("n_nationkey").alias("ord"),
    )


ARCHIVES = "a AS (SELECT r_name AS tag, n_name AS sub_key, upper(n_name) AS en, n_nationkey AS ord FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"WITH {ARCHIVES} SELECT tag, en FROM a")
def q_archives_flat(spark, sf_dir):
    """All (tag, sub-archive) pairs out of a map of maps."""
    nested = archives(spark, sf_dir).groupBy("tag").agg(F.map_from_entries(F.collect_list(F.struct("sub_key", "en"))).alias("subs"))
    return nested.select("tag", F.explode("subs").alias("sub_key", "en")).select("tag", "en")


@query("SELECT p_brand AS uk, max_by(p_name, p_partkey) AS value, min(p_partkey) AS first_seen FROM part GROUP BY 1")
def q_subarchive_distinct(spark, sf_dir):
    """Distinct names with the last value of each, in the order they were first seen."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("uk")).agg(
        F.max_by("p_name", "p_partkey").alias("value"), F.min("p_partkey").alias("first_seen")
    )


@query(
    f"""WITH {ARCHIVES} SELECT 'any' AS asked, tag, arg_min(sub_key, ord) AS sub_key FROM a GROUP BY tag
UNION ALL SELECT 'NATION_7', tag, arg_min(sub_key, ord) FROM a WHERE sub_key = 'NATION_7' OR en = 'NATION_7' GROUP BY tag"""
)
def q_archive_lookup(spark, sf_dir):
    a = archives(spark, sf_dir)
    anything = tree.find_sub(a, F.lit(None).cast("string")).withColumn("asked", F.lit("any"))
    named = tree.find_sub(a, F.lit("NATION_7")).withColumn("asked", F.lit("NATION_7"))
    return anything.unionByName(named).select("asked", "tag", "sub_key")


@query(f"WITH {HIERARCHY} SELECT archive, fond, opus, kase, ts FROM h WHERE archive = 'ASIA' AND fond = 'NATION_2'")
def q_path_lookup(spark, sf_dir):
    """Rows at given addresses, level by level."""
    h = hierarchy(spark, sf_dir)
    found = tree.find(h, archive="ASIA", fond="NATION_2")
    return found.select("archive", "fond", "opus", F.col("case").alias("kase"), "ts")


@query(
    f"""WITH {HIERARCHY}, c AS (SELECT 'p' || n_name AS page, n_name AS row_key, '/wiki/r/' || n_name AS link, n_nationkey AS k FROM nation),
c2 AS (SELECT DISTINCT r_name AS page, n_name AS row_key, 'deep/' || n_name AS link FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT 'deep/' || n_name, 'x' || n_nationkey, 'leaf/' || n_nationkey FROM nation),
asks AS (SELECT r_name AS page, 'NATION_' || r_regionkey AS entry FROM region UNION ALL SELECT r_name, 'x' || r_regionkey FROM region
 UNION ALL SELECT 'deep', 'NATION_3'),
hits AS (SELECT a.page, a.entry, 0 AS tier, c2.link AS found FROM asks a JOIN c2 USING (page) WHERE c2.row_key = a.entry OR split_part(c2.link, '/', 2) = a.entry
 UNION ALL SELECT a.page, a.entry, 1, a.page || '/' || a.entry FROM asks a WHERE EXISTS (SELECT 1 FROM c2 WHERE c2.page = a.page || '/' || a.entry)
 UNION ALL SELECT a.page, a.entry, 2, d.link FROM asks a JOIN c2 USING (page) JOIN c2 d ON d.page = c2.link WHERE d.row_key = a.entry OR split_part(d.link, '/', 2) = a.entry)
SELECT page, entry, CAST(arg_min(tier, (tier, found)) AS INTEGER) AS tier, arg_min(found, (tier, found)) AS found FROM hits GROUP BY page, entry"""
)
def q_tiered_lookup(spark, sf_dir):
    """A page's entry by its own rows, by a page below it, or by the rows of the pages that it leads to."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    deep = F.concat(F.lit("deep/"), "n_name")
    cells = named.select(F.col("r_name").alias("page"), F.col("n_name").alias("row_key"), deep.alias("link")).unionByName(
        nations.select(
            deep.alias("page"),
            F.concat(F.lit("x"), "n_nationkey").alias("row_key"),
            F.concat(F.lit("leaf/"), "n_nationkey").alias("link"),
        )
    )
    asks = (
        regions.select(F.col("r_name").alias("page"), F.concat(F.lit("NATION_"), "r_regionkey").alias("entry"))
        .unionByName(regions.select(F.col("r_name").alias("page"), F.concat(F.lit("x"), "r_regionkey").alias("entry")))
        .unionByName(spark.createDataFrame([("deep", "NATION_3")], "page string, entry string"))
    )
    return tree.lookup(asks, cells, cells.select("page").distinct())


@query(f"WITH {HIERARCHY} SELECT o_orderkey, archive || ',' || subarchive || ',' || fond || ',' || opus || ',' || kase AS address FROM h")
def q_address_key(spark, sf_dir):
    return hierarchy(spark, sf_dir).select("o_orderkey", links.address_key(*[F.col(c) for c in links.ADDRESS]).alias("address"))


@query(
    f"""WITH {HIERARCHY} SELECT o_orderkey, archive || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '/' || fond END || '/' || opus AS path,
CASE WHEN o_orderkey % 3 = 0 THEN archive ELSE archive || '>' || fond || '>' || opus || '>' || kase END AS crumbs,
list_extract(['archive', 'fond', 'opus', 'case'], CAST(o_orderkey % 4 + 1 AS INTEGER)) AS kind FROM h"""
)
def q_page_path(spark, sf_dir):
    """Paths without empty parts, breadcrumbs up to the first empty part, and kinds by level."""
    h = hierarchy(spark, sf_dir).withColumn("fond", F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("fond")))
    return h.select(
        "o_orderkey",
        links.page_path(F.col("archive"), F.col("fond"), F.col("opus")).alias("path"),
        F.array_join(links.breadcrumb(*[F.col(c) for c in links.ADDRESS]), ">").alias("crumbs"),
        links.kind_of((F.col("o_orderkey") % 4).cast("int")).alias("kind"),
    )


@query(
    """WITH t AS (SELECT 'Ns:' || r_name || '/' || n_name || '/a/b/c' AS title, r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT title, r_name || ',_,' || n_name || ',a,b' AS address FROM t UNION ALL SELECT 'Ns:' || r_name, r_name || ',_,,,' FROM region"""
)
def q_title_address(spark, sf_dir):
    """Addresses of titles: five parts, filled up or cut."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    titles = named.select("r_name", F.concat(F.lit("Ns:"), "r_name", F.lit("/"), "n_name", F.lit("/a/b/c")).alias("title"))
    titles = titles.unionByName(regions.select("r_name", F.concat(F.lit("Ns:"), "r_name").alias("title")))
    return titles.select("title", links.title_address(F.col("r_name"), F.lit("_"), F.col("title")).alias("address"))


@query(
    f"""WITH {HIERARCHY}, l AS (SELECT archive, fond, opus, max(ts) AS ts FROM h GROUP BY ALL),
n AS (SELECT DISTINCT archive AS path, 0 AS level FROM l UNION SELECT DISTINCT archive || '/' || fond, 1 FROM l UNION SELECT archive || '/' || fond || '/' || opus, 2 FROM l)
SELECT n.path, CAST(n.level AS INTEGER) AS level, l.ts AS payload FROM n LEFT JOIN l ON n.path = l.archive || '/' || l.fond || '/' || l.opus"""
)
def q_tree_flatten(spark, sf_dir):
    """The tree of changed addresses in pre-order, with the ancestors that didn't change themselves."""
    leaves = hierarchy(spark, sf_dir).groupBy("archive", "fond", "opus").agg(F.max("ts").alias("ts"))
    flat = tree.flatten(leaves.select(F.array("archive", "fond", "opus").alias("path"), "ts"), "path", "ts")
    return flat.orderBy(tree.preorder(F.col("path"))).select(F.array_join("path", "/").alias("path"), "level", "payload")


@query(
    """WITH b AS (SELECT p_partkey, replace(p_brand, '#', '-') AS name FROM part),
k AS (SELECT p_partkey, name, TRY_CAST(regexp_extract(name, '^([A-Za-z-]*)([0-9]+)([A-Za-z-]*)$', 2) AS BIGINT) AS num,
 regexp_extract(name, '^([A-Za-z-]*)([0-9]+)([A-Za-z-]*)$', 1) AS prefix FROM b)
SELECT p_partkey, name, num, prefix, CAST(rank() OVER (ORDER BY num, prefix) AS INTEGER) AS place FROM k"""
)
def q_natural_sort_key(spark, sf_dir):
    """Natural order of names: by number, then by what stands before it."""
    from pyspark.sql import Window

    parts = table(spark, sf_dir, "part").select("p_partkey", F.replace("p_brand", F.lit("#"), F.lit("-")).alias("name"))
    keyed = parts.withColumn("k", text.natural_key(F.col("name")))
    # Names are few: they are ranked once each, not once a row.
    counts = keyed.groupBy("k").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    places = counts.select("k", (F.coalesce(before, F.lit(0)) + 1).cast("int").alias("place"))
    return keyed.join(places, "k").select(
        "p_partkey", "name", F.col("k.number").try_cast("bigint").alias("num"), F.col("k.prefix").alias("prefix"), "place"
    )


@query(f"WITH {HIERARCHY} SELECT DISTINCT archive || '/' || fond AS path FROM h WHERE ts >= TIMESTAMP '2001-07-20'")
def q_needs_resolve(spark, sf_dir):
    """Pages with a pending update below them."""
    h = hierarchy(spark, sf_dir)
    pages = h.select(F.array("archive", "fond").alias("path")).distinct()
    pending = h.where(since(F.col("ts"), "2001,07,20")).select(F.array("archive", "fond", "opus", "case").alias("path"))
    return watch.needs_resolve(pages, pending).select(F.array_join("path", "/").alias("path"))


FOREST = """c AS (SELECT 'world' AS page, CAST(r_regionkey AS BIGINT) AS ord, r_name AS row_key, 'r' || r_regionkey AS link FROM region
 UNION ALL SELECT 'r' || n_regionkey, n_nationkey, n_name, 'n' || n_nationkey FROM nation
 UNION ALL SELECT 'n' || c_nationkey, c_custkey, 'C' || c_custkey % 50, 'c' || c_custkey FROM customer
 UNION ALL SELECT 'c' || o_custkey, o_orderkey, 'O' || o_orderkey % 97, CASE WHEN o_orderkey % 10 = 0 THEN 'c' || o_custkey ELSE 'o' || o_orderkey END FROM orders)"""


@query(
    f"""WITH RECURSIVE {FOREST}, a AS (SELECT 'r' || r_regionkey AS page, e.entry FROM region, (SELECT 'O' || x AS entry FROM unnest(range(0, 97, 8)) t(x) UNION ALL SELECT 'C' || x FROM unnest([3, 49, 77]) t(x)) e UNION ALL SELECT 'world', 'C7'),
w AS (SELECT a.page, a.entry, c.link, c.row_key, [c.ord] AS place, [a.page] AS seen FROM a JOIN c ON c.page = a.page
 UNION ALL SELECT w.page, w.entry, c.link, c.row_key, list_append(w.place, c.ord), list_append(w.seen, w.link) FROM w JOIN c ON c.page = w.link WHERE NOT list_contains(w.seen, w.link))
SELECT page, entry, array_to_string(min(place), '.') AS place, arg_min(link, place) AS found FROM w WHERE row_key = entry GROUP BY page, entry"""
)
def q_deep_lookup(spark, sf_dir):
    """Entries below regions, found depth-first in a tree of four levels some of whose leaves lead back to their page."""
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    region, nation, customer, orders = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))

    def level(rows, page, number, key, link):
        return rows.select(page.alias("page"), F.col(number).cast("long").alias("ord"), key.alias("row_key"), link.alias("link"))

    back = F.when(F.col("o_orderkey") % 10 == 0, text("c", "o_custkey")).otherwise(text("o", "o_orderkey"))
    cells = (
        level(region, F.lit("world"), "r_regionkey", F.col("r_name"), text("r", "r_regionkey"))
        .unionByName(level(nation, text("r", "n_regionkey"), "n_nationkey", F.col("n_name"), text("n", "n_nationkey")))
        .unionByName(level(customer, text("n", "c_nationkey"), "c_custkey", F.concat(F.lit("C"), (F.col("c_custkey") % 50).cast("string")), text("c", "c_custkey")))
        .unionByName(level(orders, text("c", "o_custkey"), "o_orderkey", F.concat(F.lit("O"), (F.col("o_orderkey") % 97).cast("string")), back))
    )
    entries = [f"O{x}" for x in range(0, 97, 8)] + ["C3", "C49", "C77"]
    asks = region.select(text("r", "r_regionkey").alias("page"), F.explode(F.array(*map(F.lit, entries))).alias("entry"))
    asks = asks.unionByName(spark.createDataFrame([("world", "C7")], "page string, entry string"))
    return tree.deep_lookup(asks, cells).select("page", "entry", F.array_join(F.transform("place", lambda o: o.cast("string")), ".").alias("place"), "found")
