"""Lists of archives, parsed cells, JSON, set operations; and a few built-ins that have no operator of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import export, lists
from .registry import query, table


@query(
    """WITH g AS (SELECT r_name AS tag, CASE n_nationkey % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'A' ELSE n_name END AS sub_key, n_name AS title, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT tag, sub_key, arg_max(title, k) AS title FROM g GROUP BY tag, sub_key),
o AS (SELECT r_name AS tag, '_' AS sub_key, 'own ' || r_name AS title FROM region UNION ALL SELECT r_name, 'A', 'listed' FROM region WHERE r_regionkey = 1)
SELECT tag, sub_key, title FROM o UNION ALL SELECT tag, sub_key, title FROM f WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.tag = f.tag AND o.sub_key = f.sub_key)"""
)
def q_master_list(spark, sf_dir):
    """Sub-archives found on pages under Latin letters, and the listed fonds over them."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("n_nationkey") % 3
    sub = F.when(k == 0, "Р").when(k == 1, "А").otherwise(F.col("n_name"))
    found = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("tag"), sub.alias("sub_key"), F.col("n_name").alias("title"), "n_nationkey"
    )
    # Of pages that name one sub-archive the last counts.
    found = found.groupBy("tag", "sub_key").agg(F.max_by("title", "n_nationkey").alias("title"))
    fonds = regions.select(F.col("r_name").alias("name"), F.concat(F.lit("own "), "r_name").alias("title")).unionByName(
        regions.where("r_regionkey = 1").select(F.concat("r_name", F.lit("-A")).alias("name"), F.lit("listed").alias("title"))
    )
    return lists.master_list(found, fonds)


@query(
    """SELECT c_custkey, c_custkey % 4 = 0 OR c_mktsegment = 'BUILDING' OR c_custkey % 7 = 0 AS hit FROM customer"""
)
def q_entry_hit(spark, sf_dir):
    """Rows that are asked for by their text, its translation or the last part of their link."""
    uk = F.when(F.col("c_custkey") % 4 == 0, "asked é").otherwise("other é")
    item = F.struct(uk.alias("uk"), F.when(F.col("c_mktsegment") == "BUILDING", "asked é").alias("en"), (F.col("c_mktsegment") == "BUILDING").alias("en_set"))
    link = F.when(F.col("c_custkey") % 7 == 0, "/wiki/a/asked%20%C3%A9").otherwise("/wiki/none")
    return table(spark, sf_dir, "customer").select("c_custkey", lists.row_hit(item, link, F.lit("asked é")).alias("hit"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS number, CASE WHEN p_size % 2 = 0 THEN 'http://x/' || p_partkey ELSE '' END AS url, CASE WHEN p_size % 2 = 0 THEN '1900-01' ELSE '' END AS date FROM part")
def q_parse_cells(spark, sf_dir):
    """Cells of a number, an address and a date."""
    size = F.col("p_size").cast("string")
    cell = F.when(F.col("p_size") % 2 == 0, F.concat(size, F.lit(" (http://x/"), F.col("p_partkey").cast("string"), F.lit(") 1900-01"))).otherwise(size)
    return table(spark, sf_dir, "part").select("p_partkey", lists.parse_number_cell(cell).alias("c")).select("p_partkey", "c.*")


@query(
    """SELECT n_nationkey, '{"n_name":"' || n_name || '","kind":"archive","doc":null,"n_regionkey":' || n_regionkey || '}' AS json FROM nation"""
)
def q_page_json(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit("archive").alias("kind"), F.lit(None).cast("string").alias("doc"), "n_regionkey")
    return rows.select("n_nationkey", lists.page_json("n_name", "kind", "doc", "n_regionkey").alias("json"))


@query("SELECT a.n_name AS old, b.r_name AS new FROM nation a JOIN region b ON a.n_regionkey = b.r_regionkey")
def q_key_mapping(spark, sf_dir):
    entries = table(spark, sf_dir, "nation").select(F.col("n_name").alias("old"), F.col("n_regionkey").alias("value"))
    names = table(spark, sf_dir, "region").select(F.col("r_name").alias("new"), F.col("r_regionkey").alias("value"))
    return lists.rekey(entries, names)


@query("SELECT l_returnflag, l_linenumber FROM lineitem EXCEPT ALL SELECT l_returnflag, l_linenumber FROM lineitem WHERE l_partkey % 2 = 0")
def q_bag_difference(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    cut = ["l_returnflag", "l_linenumber"]
    return lists.bag_difference(rows.select(cut), rows.where("l_partkey % 2 = 0").select(cut))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NULL")
def q_null_links(spark, sf_dir):
    """Rows without a link."""
    link = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return table(spark, sf_dir, "customer").where(link.isNull()).select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size WHEN 1 THEN 4 END AS place FROM part")
def q_index_resolve(spark, sf_dir):
    """Positions of columns: numbers as they stand, labels by the map, nothing for unknown ones."""
    k, labels = F.col("p_size") % 3, F.create_map(F.lit("DATE"), F.lit(4))
    index = F.when(k == 0, F.col("p_size").cast("string")).when(k == 1, "DATE").otherwise("NONE")
    return table(spark, sf_dir, "part").select("p_partkey", export.column_index(labels, index).alias("place"))


@query("SELECT doc_id, regexp_matches(text, '[0-9]{4}') AS dated, substr(text, 1, 3) || '...' AS hidden FROM documents")
def q_redact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike("[0-9]{4}").alias("dated"), text.redact(F.col("text")).alias("hidden"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_tumbling_windows(spark, sf_dir):
    """Built-in: events and sums of whole hours."""
    w = F.window("ts", "1 hour").alias("w")
    return table(spark, sf_dir, "events").groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("w.start", "event_type", "n", "total")


@query("SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def q_rollup_counts(spark, sf_dir):
    """Built-in: counts at each level of the hierarchy."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "n_name").agg(F.count("*").alias("n"))
