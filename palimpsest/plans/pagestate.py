"""Versions to choose from, clicks, tasks, answers, keys and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.timefmt import standard
from ..operators import state
from .registry import query, table


@query(
    """WITH m AS (SELECT DISTINCT o_custkey AS page, strftime(o_orderdate, '%Y,%m,%d,%H:%M') AS modified FROM orders)
SELECT page, modified FROM m WHERE modified <> (SELECT max(modified) FROM m c WHERE c.page = m.page)"""
)
def q_eligible_history(spark, sf_dir):
    """Minutes of a customer's orders but for the last one."""
    minutes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), standard(F.col("o_orderdate")).alias("modified")).distinct()
    return state.eligible_history(minutes, minutes.groupBy("page").agg(F.max("modified").alias("lastmod")))


@query(
    """SELECT o_orderkey, o_orderkey % 3 <> 0 AND o_orderkey % 3 <> 1 AS comparison, o_orderstatus <> 'F' AND o_custkey % 5 <> 0 AS clickable FROM orders"""
)
def q_comparison_state(spark, sf_dir):
    """Pages without another version, with the same and with another one; rows that lead somewhere."""
    lastmod, k = standard(F.col("o_orderdate")), F.col("o_orderkey") % 3
    refmod = F.when(k == 1, lastmod).when(k == 2, F.concat(lastmod, F.lit("0")))
    kind = F.when(F.col("o_orderstatus") == "F", "case").otherwise("opus")
    link = F.when(F.col("o_custkey") % 5 == 0, "/w?redlink=1").otherwise("/wiki/a")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", state.is_comparison(refmod, lastmod).alias("comparison"), state.is_clickable(kind, link).alias("clickable")
    )


@query(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'A,_,' || o_custkey || ',,' WHEN 1 THEN 'A,_,f' || o_orderstatus || ',' || o_custkey || ','
 WHEN 2 THEN 'A,_,f' || o_orderstatus || ',' || o_orderpriority || ',' || o_custkey END AS address FROM orders"""
)
def q_row_click(spark, sf_dir):
    """Where a row of an archive, a fond or an opus leads; nowhere from a case."""
    kind = F.get(F.array(*[F.lit(k) for k in ("archive", "fond", "opus", "case", "other")]), (F.col("o_orderkey") % 5).cast("int"))
    address = state.child_address(
        kind, F.col("o_custkey").cast("string"), F.lit("A"), F.lit("_"), F.concat(F.lit("f"), "o_orderstatus"), F.col("o_orderpriority")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", address.alias("address"))


@query(
    """WITH t AS (SELECT o_orderkey AS task, 'page ' || o_orderkey AS page, count(l_orderkey) FILTER (l_returnflag = 'R') AS progress, count(l_orderkey) AS total, o_orderstatus = 'O' AS running
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o_custkey AS "user", page, progress, total, running, page || ' ' || progress || '/' || total || CASE WHEN total > 0 THEN printf(' %.1f%%', 100.0 * progress / total) ELSE '' END AS line
FROM t JOIN orders ON o_orderkey = task"""
)
def q_active_tasks(spark, sf_dir):
    """Each customer's orders as tasks, with their progress."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    done = items.groupBy(F.col("l_orderkey").alias("task")).agg(F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("progress"), F.count("*").alias("total"))
    named = orders.select(F.col("o_orderkey").alias("task"), F.concat(F.lit("page "), F.col("o_orderkey").cast("string")).alias("page"), (F.col("o_orderstatus") == "O").alias("running"))
    tasks = named.join(done, "task", "left").fillna(0, ["progress", "total"])
    owners = orders.select(F.col("o_custkey").alias("user"), F.col("o_orderkey").alias("task"))
    found = state.active_tasks(owners.unionByName(owners), tasks)
    return found.withColumn("line", state.progress_line(F.col("page"), F.col("progress"), F.col("total")))


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'view,' || event_type WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE NULL END AS labels FROM events"""
)
def q_answer_check(spark, sf_dir):
    """Labels out of answers: a list of two, one of one, another kind of JSON, no JSON."""
    k, kind = F.col("event_id") % 4, F.col("event_type")
    answer = (
        F.when(k == 0, F.concat(F.lit(' ["view", "'), kind, F.lit('"]')))
        .when(k == 1, F.concat(F.lit('["'), kind, F.lit('"]')))
        .when(k == 2, F.concat(F.lit('{"a": "'), kind, F.lit('"}')))
        .otherwise(F.concat(F.lit("sorry, "), kind))
    )
    return table(spark, sf_dir, "events").select("event_id", F.array_join(state.answers(answer, F.lit(2)), ",").alias("labels"))


@query(
    """SELECT c_custkey, 'page_cache/' || c_name AS path, 'u' || c_nationkey || '/' || c_mktsegment || '-' || c_custkey AS watch FROM customer"""
)
def q_page_keys(spark, sf_dir):
    """Paths of cached pages and keys of watches."""
    user = F.concat(F.lit("u"), F.col("c_nationkey").cast("string"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", state.cache_path(F.col("c_name")).alias("path"), state.watch_key(user, F.col("c_mktsegment"), F.col("c_custkey").cast("string")).alias("watch")
    )


@query(
    """SELECT name, CAST(rank() OVER (ORDER BY lower(name)) AS INTEGER) AS place FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS name FROM nation)"""
)
def q_collated_sort(spark, sf_dir):
    """Names of either case in a reader's order."""
    name = F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name"))
    names = table(spark, sf_dir, "nation").select(name.alias("name"))
    # A fixed list of names.
    return names.select("name", F.rank().over(Window.orderBy(state.collated(F.col("name")))).alias("place"))


@query("SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_partkey) AS parts FROM lineitem GROUP BY l_orderkey")
def q_numeric_sort(spark, sf_dir):
    """An order's parts, whose numbers are texts, by number."""
    ids = F.collect_list(F.col("l_partkey").cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(state.numeric_order(ids), " ").alias("parts"))
