"""Versioned pages by key: append, read a version or the newest, delete."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Deleted pages that are told to all tasks at once; more are joined like any table.
FEW = 10_000


class VersionStore:
    """A table (archive, page, modified, payload) in a folder; a missing folder is an empty table.

    Rows lie in folders that never change, one for each write. What counts is the log beside them: a file for each write
    or deletion, which one rename puts there when everything else is done. A reader takes the log as it stands, so it sees
    whole writes only; writers don't share a file, so none can lose another's; what a writer that died has left isn't in
    the log. A deletion is an entry of the log and moves no rows: it holds for the writes before it.
    """

    SCHEMA = "archive string, page string, modified string, payload string"
    LOG = "number long, entry string, archive string, page string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log(self) -> DataFrame:
        """Entries (number, entry, archive, page): writes have the name of their folder, deletions a key."""
        try:
            return self.spark.read.schema(self.LOG).json(f"{self.path}/log")
        except AnalysisException:
            return self.spark.createDataFrame([], self.LOG)

    def _publish(self, rows: DataFrame) -> None:
        """Adds entries (entry, archive, page) after all that are there now, in one file."""
        number = (self.log().agg(F.max("number")).first()[0] or 0) + 1
        rows.select(F.lit(number).cast("long").alias("number"), "entry", "archive", "page").coalesce(1).write.mode("append").json(f"{self.path}/log")

    def _rows(self) -> DataFrame:
        """All rows of the writes of the log, with the place of their write."""
        writes = {r["entry"]: r["number"] for r in self.log().where("entry is not null").collect()}  # a row for each write
        if not writes:
            return self.spark.createDataFrame([], f"{self.SCHEMA}, entry string, number long")
        rows = self.spark.read.schema("page string, modified string, payload string, entry string, archive string").parquet(f"{self.path}/rows")
        numbers = F.create_map(*[F.lit(x) for pair in sorted(writes.items()) for x in pair])
        rows = rows.where(F.col("entry").isin(list(writes))).withColumn("number", F.element_at(numbers, F.col("entry")).cast("long"))
        return rows.select("archive", "page", "modified", "payload", "entry", "number")

    def _left(self, rows: DataFrame) -> DataFrame:
        """Rows that no later entry has deleted; of rows with one key the first that was written."""
        gone = self.log().where("entry is null").groupBy("archive", "page").agg(F.max("number").alias("until"))
        n = gone.count()
        if n:
            gone = F.broadcast(gone) if n <= FEW else gone
            rows = rows.join(gone, ["archive", "page"], "left").where("until is null or number > until")
        first = F.min_by("payload", F.struct("number", "entry")).alias("payload")
        return rows.groupBy("archive", "page", "modified").agg(first)

    def all(self) -> DataFrame:
        return self._left(self._rows())

    def save(self, pages: DataFrame) -> None:
        """Appends versions; one that is there already stays as it is. Pages that are being compared (those with a
        ``refmod``) are refused, and so are keys with a null."""
        columns = [c.split()[0] for c in self.SCHEMA.split(", ")]
        bad = F.col("archive").isNull() | F.col("page").isNull() | F.col("modified").isNull()
        if "refmod" in pages.columns:
            if not pages.where("refmod is not null").isEmpty():
                raise ValueError("a page that is being compared can't be saved")
        entry = uuid.uuid4().hex
        rows = pages.select(*columns).withColumn("entry", F.lit(entry))
        rows = rows.withColumn("page", F.when(bad, F.raise_error(F.lit("a version has no archive, page or time"))).otherwise(F.col("page")))
        rows.write.mode("append").partitionBy("entry", "archive").parquet(f"{self.path}/rows")
        none = F.lit(None).cast("string")
        self._publish(self.spark.range(1).select(F.lit(entry).alias("entry"), none.alias("archive"), none.alias("page")))

    def load(self, archive: str, page: str, modified: str | None = None) -> DataFrame:
        """The named version of a page or its newest; empty if there is none. Folders of other archives aren't read."""
        rows = self._left(self._rows().where((F.col("archive") == archive) & (F.col("page") == page)))
        if modified is not None:
            return rows.where(F.col("modified") == modified)
        return rows.orderBy(F.desc("modified")).limit(1)

    def newest(self) -> DataFrame:
        """The newest version of each page."""
        last = F.max_by(F.struct("modified", "payload"), "modified").alias("v")
        return self.all().groupBy("archive", "page").agg(last).select("archive", "page", "v.*")

    def remove(self, archive: str, page: str) -> None:
        """Deletes a page; an absent page is no error."""
        self.remove_all(self.spark.createDataFrame([(archive, page)], "archive string, page string"))

    def remove_all(self, pages: DataFrame) -> None:
        """Deletes the pages (archive, page) together."""
        self._publish(pages.select(F.lit(None).cast("string").alias("entry"), "archive", "page"))
