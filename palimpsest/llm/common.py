"""What several operators share: scratch tables, connected components, union of links inside a task."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: ASCII white space as every word pattern here takes it, for Java patterns and for translate().
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def split_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``, by a split at single spaces: cheaper than a search by a pattern."""
    return F.array_remove(F.split(plain_spaces(text), " "), "")


def plain_spaces(text: Column) -> Column:
    """``text`` with a space for each other white space; by a pattern, since translate looks up every character."""
    other = "[\\t\\n\\x0b\\x0c\\r]"
    return F.when(text.rlike(other), F.regexp_replace(text, other, " ")).otherwise(text)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of its own in a local session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    return _own[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/palimpsest/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: it is computed once, outlives any executor and starts a new plan."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    # The shuffle files of this one write are of no more use after it.
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b): a row (node, component) for every node but the smallest of each component,
    which names it. Nulls and self-links are ignored.

    Each round hooks every node to its smallest smaller neighbour, flattens the pointers by doubling and contracts the
    links. A round leaves only nodes without a smaller neighbour, so rounds grow with the logarithm of the nodes. All
    tables are written between steps; joins read them through plain exchanges, which adaptive execution splits when a
    node has many links.
    """
    links = cut(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links"
    )
    known = None
    while not links.isEmpty():
        hooked = cut(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "hooks")
        while True:
            above = hooked.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            step = cut(
                hooked.join(above, "root", "left").select(
                    "node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")
                ),
                "hooks",
            )
            hooked = step.select("node", "root")
            if step.where("moved").isEmpty():
                break
        if known is None:
            known = hooked
        else:
            later = hooked.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            known = cut(
                known.join(later, "root", "left")
                .select("node", F.coalesce("higher", "root").alias("root"))
                .unionByName(hooked),
                "roots",
            )
        for end in ("a", "b"):
            to = hooked.select(F.col("node").alias(end), F.col("root").alias("to"))
            links = links.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        links = cut(
            links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(),
            "links",
        )
    if known is None:
        known = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return known.select("node", F.col("root").alias("component"))


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites positions a[i] and b[i] in ``root``, which holds for each position the smallest of its class; in place."""
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up
