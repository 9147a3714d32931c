"""Revision histories over events: a page is a user, a revision an event."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timefmt import standard
from ..operators import history
from ..session import scratch_folder
from ..sources.store import VersionStore
from .registry import query, table

REVISIONS = "r AS (SELECT user_id AS page, event_id AS revid, ts FROM events)"


def revisions(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("revid"), "ts")


@query(f"WITH {REVISIONS} SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY page ORDER BY ts DESC, revid DESC) <= 10")
def q_history_latest_n(spark, sf_dir):
    return history.latest(revisions(spark, sf_dir), 10)


CUT = f"""WITH {REVISIONS}, o AS (SELECT *, ts < TIMESTAMP '2024-01-20' AS old FROM r),
w AS (SELECT *, sum(CAST(old AS INTEGER)) OVER (PARTITION BY page ORDER BY ts DESC, revid DESC ROWS UNBOUNDED PRECEDING) AS c,
 sum(CAST(old AS INTEGER)) OVER (PARTITION BY page) AS total, row_number() OVER (PARTITION BY page ORDER BY ts, revid) AS rn FROM o)"""


@query(f"{CUT} SELECT page, revid, ts, rn = 1 AND total = 0 AS created FROM w WHERE c = 0 OR (c = 1 AND old)")
def q_history_from_cutoff(spark, sf_dir):
    return history.from_cutoff(revisions(spark, sf_dir), "2024,01,20")


@query(
    f"""WITH {REVISIONS}, w AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY ts, revid) AS rn,
 min(ts) OVER (PARTITION BY page) >= TIMESTAMP '2024-01-01 12:00:00' AS short FROM r)
SELECT page, revid, rn = 1 AND short AS created FROM w WHERE rn = 1"""
)
def q_history_created_flag(spark, sf_dir):
    """The oldest revision of each page, and whether its page began after the cut-off."""
    found = history.from_cutoff(revisions(spark, sf_dir), "2024,01,01,11:59")
    oldest = revisions(spark, sf_dir).groupBy("page").agg(F.min(F.struct("ts", "revid")).alias("o"))
    made = found.where("created").select("page", "revid", "created")
    return oldest.select("page", F.col("o.revid").alias("revid")).join(made, ["page", "revid"], "left").select(
        "page", "revid", F.coalesce("created", F.lit(False)).alias("created")
    )


@query(
    f"""WITH {REVISIONS} SELECT page, coalesce(arg_max(revid, (ts, revid)) FILTER (ts < TIMESTAMP '2024-01-02'), arg_min(revid, (ts, revid))) AS revid,
arg_max(revid, (ts, revid)) FILTER (ts < TIMESTAMP '2024-01-02') AS strict FROM r GROUP BY page"""
)
def q_asof_or_oldest(spark, sf_dir):
    """Each page as of a day: its version then, or its oldest; and null where strict."""
    r = revisions(spark, sf_dir)
    strict = history.as_of(r, "2024,01,02", or_oldest=False).select("page", F.col("revid").alias("strict"))
    return history.as_of(r, "2024,01,02").select("page", "revid").join(strict, "page")


@query(
    f"""WITH {REVISIONS}, a AS (SELECT event_id AS ask, user_id AS page, ts - INTERVAL 6 HOUR AS at FROM events WHERE event_type = 'purchase')
SELECT a.ask, a.page, max(r.revid) AS revid FROM a LEFT JOIN r ON r.page = a.page AND r.ts <= a.at GROUP BY a.ask, a.page"""
)
def q_asof_per_row(spark, sf_dir):
    """For each purchase the page's version six hours before."""
    asks = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(
        F.col("event_id").alias("ask"), F.col("user_id").alias("page"), (F.col("ts") - F.expr("INTERVAL 6 HOUR")).alias("at")
    )
    return history.as_of_rows(asks, revisions(spark, sf_dir)).select("ask", "page", "revid")


MINUTES = f"{REVISIONS}, m AS (SELECT page, strftime(ts, '%Y,%m,%d,%H:%M') AS modified, max(revid) AS revid FROM r GROUP BY 1, 2)"
DAYS = f"{MINUTES}, d AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY page, substr(modified, 1, 10) ORDER BY modified) = 1)"


@query(f"WITH {MINUTES} SELECT * FROM m")
def q_history_dedupe(spark, sf_dir):
    return history.one_per_minute(revisions(spark, sf_dir))


@query(f"WITH {DAYS} SELECT * FROM d")
def q_history_per_day(spark, sf_dir):
    return history.oldest_per_day(history.one_per_minute(revisions(spark, sf_dir)))


@query(
    f"""WITH {DAYS}, n AS (SELECT page, count(*) AS n FROM m GROUP BY page)
SELECT m.* FROM m JOIN n USING (page) WHERE n <= 10 UNION ALL
SELECT d.* FROM d JOIN n USING (page) WHERE n > 10 QUALIFY row_number() OVER (PARTITION BY d.page ORDER BY d.modified DESC) <= 10"""
)
def q_history_compress(spark, sf_dir):
    return history.compress(revisions(spark, sf_dir), 10)


@query(f"WITH {REVISIONS} SELECT page, revid, ts = max(ts) OVER (PARTITION BY page) AS is_latest FROM r")
def q_is_latest(spark, sf_dir):
    return history.is_latest(revisions(spark, sf_dir)).select("page", "revid", "is_latest")


@query("SELECT event_id, strftime(ts, '%Y,%m,%d,%H:%M') AS modified FROM events")
def q_utc_convert(spark, sf_dir):
    """ISO times with a Z in standard form."""
    from ..functions.timefmt import from_utc

    iso = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))
    return iso.select("event_id", from_utc(F.col("iso")).alias("modified"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y,%m,%d,%H:%M') AS modified, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def q_date_standard(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", standard(F.col("o_orderdate")).alias("modified"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    )


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%d %b %Y') AS shown, upper(strftime(o_orderdate, '%d %b %Y')) || strftime(o_orderdate, ' %H:%M') AS full_form,
upper(strftime(o_orderdate, '%d %b %Y')) AS short_form FROM orders"""
)
def q_date_display(spark, sf_dir):
    from ..functions.timefmt import display, display_day

    form = standard(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        display_day(form).alias("shown"),
        display(form).alias("full_form"),
        display(form, with_time=False).alias("short_form"),
    )


@query(
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'no date here' ELSE strftime(ts, '%Y,%m,%d,%H:%M') END AS modified FROM events"""
)
def q_date_parse_text(spark, sf_dir):
    """Dates out of messages in a page's language."""
    from ..functions.timefmt import MONTHS, last_modified

    names = F.array(*[F.lit(m) for m in MONTHS])
    message = F.concat(
        F.lit("edited "),
        F.date_format("ts", "HH:mm"),
        F.lit(", "),
        F.date_format("ts", "d"),
        F.lit(" "),
        F.get(names, F.month("ts") - 1),
        F.lit(" "),
        F.date_format("ts", "yyyy"),
    )
    message = F.when(F.col("event_id") % 5 == 0, "no date here").otherwise(message)
    return table(spark, sf_dir, "events").select("event_id", last_modified(message).alias("modified"))


@query(
    """WITH v AS (SELECT 'n' || c_nationkey AS archive, 'c' || c_custkey AS page, strftime(o_orderdate, '%Y,%m,%d') AS modified, min(o_orderkey) AS k, c_custkey FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
l AS (SELECT * FROM v WHERE c_custkey % 4 <> 0 OR modified >= '1996')
SELECT archive, page, modified, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 3 <> 0 THEN 'again ' ELSE 'first ' END || k AS payload FROM
(SELECT * FROM l WHERE c_custkey % 4 <> 0 OR c_custkey % 3 <> 0) QUALIFY row_number() OVER (PARTITION BY archive, page ORDER BY modified DESC) = 1"""
)
def q_version_store(spark, sf_dir):
    """The newest versions in a store: saved, saved again (which changes nothing), deleted in part, and part of that saved
    anew."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    named = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    versions = named.groupBy(
        text("n", "c_nationkey").alias("archive"), text("c", "c_custkey").alias("page"), F.date_format("o_orderdate", "yyyy,MM,dd").alias("modified"), "c_custkey"
    ).agg(F.min("o_orderkey").cast("string").alias("k"))
    store = VersionStore(spark, f"{scratch_folder(spark)}/store")
    said = lambda word: F.concat(F.lit(word), "k").alias("payload")
    store.save(versions.select("archive", "page", "modified", said("first ")))
    store.save(versions.where("c_custkey % 5 = 0").select("archive", "page", "modified", said("second ")))
    gone = versions.where("c_custkey % 4 = 0")
    store.remove_all(gone.select("archive", "page").distinct())
    store.save(gone.where("c_custkey % 3 <> 0 AND modified >= '1996'").select("archive", "page", "modified", said("again ")))
    return store.newest()
