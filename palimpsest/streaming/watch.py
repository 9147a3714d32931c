"""The request rate and the watch list as streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: What a watch list hears of an address, in the order in which events of equal times count.
UPDATE, RESOLVE, UNRESOLVE, REMOVE = "update", "resolve", "unresolve", "remove"
#: The state store that keyed state needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "address string, status string, modified timestamp, last_resolved timestamp, last_checked timestamp, resolutions int"


def rate_stream(events: DataFrame, ts: str = "ts", late: str = "1 minute", seconds: int = 60, step: int = 10) -> DataFrame:
    """(start, events) of sliding windows over a stream; events later than ``late`` are dropped."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, f"{seconds} seconds", f"{step} seconds").alias("w"))
        .agg(F.count("*").alias("events"))
        .select(F.col("w.start").alias("start"), "events")
    )


class Watched(StatefulProcessor):
    """What is known of one address: its open change, its resolved changes, and how far it was checked. Times are
    microseconds."""

    def __init__(self, cutoff: int, ttl_ms: int | None = None):
        self.cutoff, self.ttl = cutoff, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        change = "modified long, last_resolved long"
        self.open = handle.getValueState("open", change, self.ttl)
        self.resolved = handle.getListState("resolved", change, self.ttl)
        self.checked = handle.getValueState("checked", "at long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Nulls come last; updates always have a time.
        events = sorted(rows, key=lambda r: (r["ord"] is None, r["ord"] or 0, r["modified"] is None, r["modified"] or 0))
        # Each question to a state is a message to the JVM, so none is asked whether it exists.
        open_, resolved, checked = self.open.get(), list(self.resolved.get()), self.checked.get()
        open_ = open_ and tuple(open_)
        resolved = [tuple(r) for r in resolved]
        known = (open_, list(resolved), checked and checked[0])
        checked = checked[0] if checked else self.cutoff
        removed = False
        for event in events:
            kind, at = event["kind"], event["modified"]
            if kind == UPDATE:
                # The same time as the last check counts; one that was resolved at that time or later doesn't.
                if at >= checked and (not resolved or at > resolved[-1][0]):
                    open_ = (at, resolved[-1][1] if resolved else self.cutoff)
                    removed = False
                checked = max(checked, at)
            elif kind == RESOLVE and open_ is not None:
                resolved.append(open_)
                open_ = None
            elif kind == UNRESOLVE and resolved:
                open_ = resolved.pop()
            elif kind == REMOVE:
                open_, resolved, checked, removed = None, [], self.cutoff, True
        if (open_, resolved, checked) == (*known[:2], known[2] or self.cutoff) and not removed:
            return
        if removed:
            open_, resolved = None, []
        # With a life time all is written anew, so that it begins again for all.
        if open_ != known[0] or self.ttl:
            if open_ is None:
                self.open.clear()
            else:
                self.open.update(open_)
        if resolved != known[1] or self.ttl:
            if resolved:
                self.resolved.put(resolved)
            else:
                self.resolved.clear()
        if removed:
            self.checked.clear()
        elif checked != known[2] or self.ttl:
            self.checked.update((checked,))
        shown = open_ or (resolved[-1] if resolved else (None, None))
        status = "removed" if removed else "unresolved" if open_ else "resolved" if resolved else "checked"
        yield Row(
            address=key[0],
            status=status,
            modified=shown[0],
            last_resolved=shown[1],
            last_checked=None if removed else checked,
            resolutions=len(resolved),
        )

    def close(self) -> None:
        pass


def watch_changes(events: DataFrame, cutoff: str, ttl_ms: int | None = None) -> DataFrame:
    """The changes of a watch list that a stream of events (address, kind, modified, ord) makes: a row for each address and
    batch in which something changed (columns CHANGES).

    Events of one address and batch count in the order of ``ord``. An ``update`` opens the address at its time unless that
    is before the address was last checked or not after it was last resolved; it moves the check on. ``resolve`` closes
    the open change, ``unresolve`` opens the last closed one again, ``remove`` forgets the address. Nulls in address,
    kind or modified are ignored (resolve, unresolve and remove need no time). State is kept by address in the session's
    state store, which has to be ROCKSDB; with ``ttl_ms`` what isn't written for so long is forgotten. One address's
    events of a batch are held by one task; a source's limits per batch bound them.
    """
    needed = F.col("modified").isNotNull() | F.col("kind").isin(RESOLVE, UNRESOLVE, REMOVE)
    rows = events.where(F.col("address").isNotNull() & F.col("kind").isNotNull() & needed).select(
        "address", "kind", F.unix_micros(F.col("modified").cast("timestamp")).alias("modified"), F.col("ord").cast("long").alias("ord")
    )
    start = events.sparkSession.range(1).select(F.unix_micros(F.lit(cutoff).cast("timestamp"))).first()[0]
    mode = "ProcessingTime" if ttl_ms else "None"
    found = rows.groupBy("address").transformWithState(Watched(start, ttl_ms), CHANGES.replace("timestamp", "long"), "Update", mode)
    return found.withColumns({c: F.timestamp_micros(c) for c in ("modified", "last_resolved", "last_checked")})


def watch_stream(events: DataFrame, path: str, checkpoint: str, cutoff: str, ttl_ms: int | None = None) -> StreamingQuery:
    """Writes the changes of each batch to ``path/batch=<number>``; nothing else is written, so a batch costs what changes
    in it. A batch that is run again replaces its own folder. A life time of state asks for batches without data, which
    would never end here, so the session must have spark.sql.streaming.noDataMicroBatches.enabled off."""
    if ttl_ms and events.sparkSession.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") != "false":
        raise ValueError("with ttl_ms, spark.sql.streaming.noDataMicroBatches.enabled must be false")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    changes = watch_changes(events, cutoff, ttl_ms)
    return (
        changes.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def watch_list(spark: SparkSession, path: str) -> DataFrame:
    """The newest change of each address that isn't removed, from the folders that ``watch_stream`` writes."""
    changes = spark.read.schema(f"{CHANGES}, batch int").parquet(path)
    names = [f.split()[0] for f in CHANGES.split(", ")]
    newest = changes.groupBy("address").agg(F.max_by(F.struct(*names[1:]), "batch").alias("c"))
    return newest.select("address", "c.*").where("status <> 'removed'")
