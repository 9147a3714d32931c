"""Rates, logs, progress, shared tasks; and streams with their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.timefmt import MONTHS, since
from ..operators import ops
from ..session import scratch_folder
from ..sources.feed import ChangeFeed, hit_time
from ..streaming.watch import REMOVE, RESOLVE, ROCKSDB, UNRESOLVE, UPDATE, rate_stream, watch_list, watch_stream
from .registry import query, table

RATE = """WITH w AS (SELECT date_trunc('hour', ts) + INTERVAL (x * 600) SECOND - INTERVAL 3000 SECOND + INTERVAL (y * 0) SECOND AS start, ts FROM events, (SELECT unnest(range(0, 12)) AS x, 0 AS y) WHERE event_type = 'error'),
v AS (SELECT start, count(*) AS events FROM w WHERE ts >= start AND ts < start + INTERVAL 3600 SECOND GROUP BY start)"""


@query(f"{RATE} SELECT start, events, round(events / 3600.0, 9) AS rate FROM v")
def q_fetch_rate_sliding(spark, sf_dir):
    """Events of a sliding hour every ten minutes, and their rate a second."""
    errors = table(spark, sf_dir, "events").where("event_type = 'error'")
    return ops.sliding_rate(errors, "ts", 3600, 600).select("start", "events", F.round("rate", 9).alias("rate"))


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def q_log_tail(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return ops.tail(log, 100, "ts", "event_id").select("event_id", "event_type")


@query("SELECT event_id, user_id FROM events QUALIFY (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 7 = 0")
def q_sample_every_n(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    return ops.every_nth(events, 7, "user_id", "event_id")


@query("SELECT conv_id, round(100.0 * count(*) FILTER (role = 'user') / count(*), 1) AS pct FROM conversations GROUP BY conv_id")
def q_progress_pct(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id")
    return turns.agg(ops.percent(F.count(F.when(F.col("role") == "user", 1)), F.count("*")).alias("pct"))


@query(
    """SELECT event_type || user_id % 10 AS page, arg_min(event_id, (ts, event_id)) AS task, count(DISTINCT user_id) AS users FROM events GROUP BY 1"""
)
def q_task_dedupe(spark, sf_dir):
    """One task for each page, shared by those who ask for it."""
    page = F.concat("event_type", (F.col("user_id") % 10).cast("string"))
    asks = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), page.alias("page"), "ts", F.col("event_id").alias("task"))
    return ops.shared_tasks(asks)


def _stream(spark, sf_dir, name):
    """A table's file as a stream: a folder of one file."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(sf_dir)


@query(f"{RATE} SELECT start, events FROM v")
def s_rate_stream(spark, sf_dir):
    """The sliding rate as a stream, run over what is there."""
    name = f"rate_{uuid.uuid4().hex}"
    errors = _stream(spark, sf_dir, "events").where("event_type = 'error'").withColumn("ts", F.col("ts").cast("timestamp"))
    run = rate_stream(errors, "ts", "1 hour", 3600, 600).writeStream.outputMode("complete").format("memory").queryName(name)
    run.trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "events")


FOLD = """e AS (SELECT 'u' || user_id AS address, event_id, date_trunc('hour', ts) AS t,
 CASE WHEN event_id % 89 = 0 THEN 'remove' WHEN event_type = 'purchase' THEN 'resolve' WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'unresolve' ELSE 'update' END AS kind FROM events),
g AS (SELECT address, list({'kind': kind, 't': t} ORDER BY event_id % 4, event_id) AS heard FROM e GROUP BY address),
f AS (SELECT address, list_reduce(heard, lambda s, x: CASE
 WHEN x.kind = 'update' THEN {'now': CASE WHEN x.t >= s.checked AND (len(s.done) = 0 OR x.t > s.done[-1]) THEN x.t ELSE s.now END, 'done': s.done, 'checked': greatest(s.checked, x.t), 'kind': '', 't': s.t}
 WHEN x.kind = 'resolve' AND s.now IS NOT NULL THEN {'now': NULL, 'done': list_append(s.done, s.now), 'checked': s.checked, 'kind': '', 't': s.t}
 WHEN x.kind = 'unresolve' AND len(s.done) > 0 THEN {'now': s.done[-1], 'done': s.done[:-2], 'checked': s.checked, 'kind': '', 't': s.t}
 WHEN x.kind = 'remove' THEN {'now': NULL, 'done': [], 'checked': s.t, 'kind': '', 't': s.t}
 ELSE s END, {'now': CAST(NULL AS TIMESTAMP), 'done': CAST([] AS TIMESTAMP[]), 'checked': TIMESTAMP '2023-12-31', 'kind': '', 't': TIMESTAMP '2023-12-31'}) AS s FROM g)"""


@query(
    f"""WITH {FOLD} SELECT address, CASE WHEN s.now IS NOT NULL THEN 'unresolved' ELSE 'resolved' END AS status, coalesce(s.now, s.done[-1]) AS modified,
 s.t AS last_resolved, s.checked AS last_checked, CAST(len(s.done) AS INTEGER) AS resolutions FROM f WHERE s.now IS NOT NULL OR len(s.done) > 0"""
)
def s_watch_stream(spark, sf_dir):
    """The watch list as a keyed stream: four batches of events whose times overlap, so that some come late, some repeat a
    time and some remove their address. The stream stops after each batch and goes on from its checkpoint."""
    number = F.col("event_id")
    kind = (
        F.when(number % 89 == 0, REMOVE)
        .when(F.col("event_type") == "purchase", RESOLVE)
        .when((F.col("event_type") == "error") & (number % 3 == 0), UNRESOLVE)
        .otherwise(UPDATE)
    )
    address = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    events = table(spark, sf_dir, "events").select(
        address.alias("address"), kind.alias("kind"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("modified"), number.alias("ord")
    )
    folder = scratch_folder(spark)
    # A session of its own: the state store is chosen by a setting, and each core holds one share of the state.
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism)
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    for batch in range(4):
        events.where(F.col("ord") % 4 == batch).write.parquet(f"{folder}/events/batch={batch}")
        stream = own.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/events")
        # Each start finds one new folder and goes on from the checkpoint that the start before left.
        watch_stream(stream, f"{folder}/changes", f"{folder}/checkpoint", "2023-12-31").awaitTermination()
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("modified", "last_resolved", "last_checked")}
    return watch_list(spark, f"{folder}/changes").withColumns(times)


@query(
    """SELECT event_id, CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER w AS DOUBLE) / count(*) OVER w AS ratio
FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""
)
def q_running_ratio(spark, sf_dir):
    """The share of events without error so far, in one order of all events."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("event_type") != "error").alias("fine"))
    return ops.success_ratio(events, ["ts", "event_id"], "fine").select("event_id", "ratio")


FEED_CUTOFF = "2024,01,05"


@query(
    f"""SELECT 'Case/' || event_id AS title, '/wiki/Case/' || event_id AS link, strftime(ts, '%Y,%m,%d,%H:%M') AS lastmod FROM events
WHERE strftime(ts, '%Y,%m,%d,%H:%M') >= '{FEED_CUTOFF}'"""
)
def s_feed_stream(spark, sf_dir):
    """Hits of a feed of changes that grows while it is watched: the stream reads what there is, stops, and goes on from its
    checkpoint when newer hits have moved the others to later pages. Each hit comes once."""
    names = F.create_map(*[F.lit(x) for name, number in MONTHS.items() for x in (int(number), name)])
    ts, title = F.col("ts"), F.concat(F.lit("Case/"), F.col("event_id").cast("string"))
    date = F.concat(F.date_format(ts, "HH:mm, d "), F.element_at(names, F.month(ts)), F.date_format(ts, " yyyy"))
    events = table(spark, sf_dir, "events").select("ts", title.alias("title"), F.concat(F.lit("/wiki/"), title).alias("link"), F.concat(F.lit("3 KB (40 words) - "), date).alias("data"))
    folder = scratch_folder(spark)
    spark.dataSource.register(ChangeFeed)

    def publish(hits):
        """The feed as it stands: newest first, a thousand hits a page."""
        placed = ops.numbered(hits, F.desc(F.date_trunc("minute", "ts")), F.desc("title"))
        pages = placed.select(F.floor(F.col("n") / 1000).alias("page"), "n", F.to_json(F.struct("title", "link", "data")).alias("value"))
        pages = pages.repartition("page").sortWithinPartitions("page", "n").drop("n")
        pages.write.mode("overwrite").partitionBy("page").text(f"{folder}/feed")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/hits/batch={number}")

    for hits in (events.where(~since(ts, "2024,01,20")), events):
        publish(hits)
        feed = spark.readStream.format("change_feed").option("path", f"{folder}/feed").option("cutoff", FEED_CUTOFF).load()
        run = feed.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/feed-checkpoint")
        run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/hits").select("title", "link", hit_time(F.col("data")).alias("lastmod"))
