"""Streams: the keyed watch list and the feed of changes."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import ops
from palimpsest.sources.feed import Folder, FeedReader, hit_time, place_of
from palimpsest.streaming import watch

EVENTS = "address string, kind string, modified timestamp, ord long"


def day(n):
    return dt.datetime(2024, 1, n)


@pytest.fixture
def folds(spark, tmp_path):
    """A function that gives a stream one more batch of events and returns the watch list."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", watch.ROCKSDB)
    own.conf.set("spark.sql.shuffle.partitions", 2)
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")

    def fold(*events, ttl=None):
        spark.createDataFrame(list(events), EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = own.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
        watch.watch_stream(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", "2023-12-31", ttl).awaitTermination()
        return {r.address: (r.status, r.modified and r.modified.day, r.resolutions) for r in watch.watch_list(spark, f"{tmp_path}/out").collect()}

    return fold


def test_watch_list_over_batches(spark, folds, tmp_path):
    got = folds(("a", "update", day(3), 1), ("b", "update", day(2), 2), ("a", "update", day(1), 3), (None, "update", day(9), 4), ("n", "update", None, 5))
    # Of a, the late update of the 1st is not looked at; nulls are ignored.
    assert got == {"a": ("unresolved", 3, 0), "b": ("unresolved", 2, 0)}
    got = folds(("a", "resolve", None, 6), ("b", "remove", None, 7), ("c", "resolve", None, 8))
    assert got == {"a": ("resolved", 3, 1)}
    # The time it was resolved at doesn't open it again, and nothing is written for it.
    got = folds(("a", "update", day(3), 9), ("b", "update", day(1), 10))
    assert got == {"a": ("resolved", 3, 1), "b": ("unresolved", 1, 0)}
    assert spark.read.parquet(f"{tmp_path}/out/batch=2").count() == 1
    got = folds(("a", "update", day(4), 11), ("a", "resolve", None, 12), ("a", "unresolve", None, 13), ("b", "update", day(1), 14))
    assert got == {"a": ("unresolved", 4, 1), "b": ("unresolved", 1, 0)}


def test_unchanged_states_are_not_written():
    said = []

    class State:
        def __init__(self, value):
            self.value = value

        def __getattr__(self, name):
            said.append(name)
            return lambda *new: self.value if name == "get" else None

    heard = watch.Watched(0)
    heard.open, heard.resolved, heard.checked = State((5, 0)), State([]), State((5,))
    at = lambda n, kind="update": [{"kind": kind, "modified": n, "ord": 1}]
    assert list(heard.handleInputRows(("a",), iter(at(3)), None)) == [] and said == ["get"] * 3
    said.clear()
    (row,) = heard.handleInputRows(("a",), iter(at(None, "resolve")), None)
    assert (row.status, row.modified, row.last_checked, row.resolutions) == ("resolved", 5, 5, 1)
    assert said == ["get"] * 3 + ["clear", "put"]


def test_state_with_a_life_time(folds):
    assert folds(("a", "update", day(3), 1), ttl=3_600_000) == {"a": ("unresolved", 3, 0)}


def feed(path, hits, size):
    for page in range(0, len(hits), size):
        folder = path / f"page={page // size}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "part-0.txt").write_text("\n".join(map(json.dumps, hits[page : page + size])))


def hit(n):
    return {"title": f"T{n:05d}", "link": f"/wiki/T{n}", "data": f"2 KB (3 words) - {n % 24:02d}:05, {1 + n // 24 % 28} травня 2024"}


@pytest.mark.parametrize("count", [0, 1, 49, 50, 51, 400, 700])
def test_each_hit_is_in_one_partition(tmp_path, count):
    hits = sorted((hit(n) for n in range(count)), key=place_of, reverse=True)
    feed(tmp_path, hits, 30)
    reader = FeedReader({"path": str(tmp_path), "hits": "30", "cutoff": "2024,05,03"})
    start, end = reader.initialOffset(), reader.latestOffset()
    spans = reader.partitions(start, end)
    found = [r[0] for s in spans for r in reader.read(s)]
    assert sorted(found) == sorted(h["title"] for h in hits if place_of(h) > ("2024,05,03", ""))
    # The feed has grown since: the same batch again has the same hits, wherever they are now.
    newer = [hit(n) | {"data": "- 10:00, 30 травня 2024"} for n in range(900, 1000)]
    feed(tmp_path, sorted(hits + newer, key=place_of, reverse=True), 30)
    assert sorted(r[0] for s in spans for r in reader.read(s)) == sorted(found)
    again = FeedReader({"path": str(tmp_path), "hits": "30"})
    later = [r[0] for s in again.partitions(end, again.latestOffset()) for r in again.read(s)]
    assert sorted(later) == sorted(h["title"] for h in newer)


def test_long_pages_are_read_in_pieces(tmp_path, monkeypatch):
    from palimpsest.sources import feed as module

    monkeypatch.setattr(module, "LONGEST", 100)
    monkeypatch.setattr(module, "PIECE", 20)
    hits = sorted((hit(n) for n in range(650)), key=place_of, reverse=True)
    feed(tmp_path, hits, 30)
    reader = FeedReader({"path": str(tmp_path), "hits": "30"})
    spans = reader.partitions(reader.initialOffset(), reader.latestOffset())
    asked, page = [], reader.feed.page
    monkeypatch.setattr(reader.feed, "page", lambda limit, offset: asked.append(limit) or page(limit, offset))
    read = [[r[0] for r in reader.read(s)] for s in spans]
    assert sorted(sum(read, [])) == sorted(h["title"] for h in hits)
    assert max(map(len, read)) <= 100 and max(asked) <= 20


def test_folder_pages(tmp_path):
    feed(tmp_path, [hit(n) for n in range(25)], 10)
    pages = Folder(f"file:{tmp_path}", 10)
    assert [h["title"] for h in pages.page(7, 8)] == [f"T{n:05d}" for n in range(8, 15)]
    assert pages.page(5, 25) == [] and len(pages.page(100, 0)) == 25


def test_hit_times(spark):
    rows = [("2 KB (3 words) - 09:05, 7 травня 2024",), ("09:05, 17 травня 2024",), ("a - b - c",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "d string").select(hit_time(F.col("d"))).collect()]
    assert got[:2] == ["2024,05,07,09:05", "2024,05,17,09:05"] and got[3] is None




def test_running_sums(spark):
    import random

    rng = random.Random(1)
    rows = [(i, rng.randrange(10**6), rng.choice([None, 1, 2, 3]), "x") for i in range(3000)]
    frame = spark.createDataFrame(rows, "id long, at long, v long, total string").repartition(7)

    got = {r.id: (r.n, r.s) for r in ops.running(frame, {"n": F.lit(1).cast("long"), "s": F.col("v")}, "at", "id").collect()}
    total, want = 0, {}
    for n, (i, _, v, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1):
        total += v or 0
        want[i] = (n, total)
    assert got == want
    assert ops.running(frame.where("id < 0"), {"n": F.lit(1)}, "id").count() == 0
    plan = ops.success_ratio(frame.withColumn("ok", F.col("v") == 1), "id", "ok")._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
