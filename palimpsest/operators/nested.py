"""Text items anywhere in nested documents: found by path, translated once for each text, and put back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

#: What a node is known by: its document and the positions that lead to it.
NODE = ["id", "path"]


def quoted(text: Column) -> Column:
    """A string as JSON."""
    inside = F.to_json(F.array(text))
    return inside.substr(F.lit(2), F.length(inside) - 2)


def wanted(value: Column) -> Column:
    """The text of an object that has one (``uk``) and no ``en``; one that is there but null is a translation."""
    text = F.try_variant_get(value, "$.uk", "variant")
    missing = F.try_variant_get(value, "$.en", "variant").isNull()
    return F.when(missing & (F.schema_of_variant(text) == "STRING"), F.try_variant_get(value, "$.uk", "string"))


def nodes(docs: DataFrame) -> DataFrame:
    """(id, path, steps, key, shape, json, text) of every value in documents (id, value variant) of any shape and depth.

    ``path`` are the positions of a value and those around it, the root's is empty; ``steps``
    are the same with names in objects, as JSON; ``key`` is its name within an object, null in arrays; ``json`` is the value itself where it holds no other, else null and ``shape`` is ``{}`` or ``[]``; ``text``
    is what an item still has to be translated from. Null documents give no rows; ids must be distinct. Each level is
    exploded in one round and written, so rounds are as many as the deepest document is deep.
    """
    spark = docs.sparkSession
    level = docs.where("value is not null").select(
        "id", F.array().cast("array<int>").alias("path"), F.array().cast("array<string>").alias("steps"), F.lit(None).cast("string").alias("key"), "value"
    )
    found = None
    while True:
        inner = spark.tvf.variant_explode_outer(F.col("value").outer()).toDF("pos", "name", "child")
        rows = written(level.withColumn("text", wanted(F.col("value"))).lateralJoin(inner), "level")
        # A value without values in it has one row without a position.
        single = F.col("pos").isNull()
        shape = F.when(single, None).when(F.col("name").isNull(), "[]").otherwise("{}")
        here = rows.where(single | (F.col("pos") == 0)).select(
            *NODE, "steps", "key", shape.alias("shape"), F.when(single, F.to_json("value")).alias("json"), "text"
        )
        found = here if found is None else found.unionByName(here)
        below = rows.where(~single)
        if below.isEmpty():
            return written(found, "nodes")
        step = F.when(F.col("name").isNull(), F.col("pos").cast("string")).otherwise(quoted(F.col("name")))
        level = below.select(
            "id", F.array_append("path", F.col("pos")).alias("path"), F.array_append("steps", step).alias("steps"), F.col("name").alias("key"), F.col("child").alias("value")
        )


def place(steps: Column) -> Column:
    """The way to a value as a JSON array of names and positions."""
    return F.concat(F.lit("["), F.array_join(steps, ","), F.lit("]"))


def untranslated(found: DataFrame) -> DataFrame:
    """(id, path, text): the items that need a translation."""
    return found.where("text is not null").select(*NODE, "text")


def put_back(found: DataFrame, translations: DataFrame) -> DataFrame:
    """(id, json): documents from their nodes, each item with the translation (text, en) of its text as ``en``.

    Texts without a translation keep their item as it is; of several translations of a text the smallest counts. Objects
    have their keys in ascending order. Values are joined to those around them level by level, from the deepest.
    """
    once = translations.where("en is not null").groupBy("text").agg(F.min("en").alias("en"))
    items = untranslated(found).join(once, "text").select(*NODE, "en")
    new = items.select("id", F.col("path").alias("parent"), F.lit("en").alias("key"), F.lit(-1).alias("pos"), quoted(F.col("en")).alias("json"))
    placed = found.withColumns({"parent": F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), "pos": F.element_at("path", -1)})
    kept = placed.where("size(path) > 0").select("id", "path", "parent", "key", "pos", "shape", "json")
    added = new.withColumns({"path": F.array_append("parent", F.lit(-1)), "shape": F.lit(None).cast("string")})
    kept = written(kept.unionByName(added), "kept")
    roots = placed.where("size(path) = 0").select("id", "path", "shape", "json")
    shapes = written(kept.select("id", "path", "shape").unionByName(roots.select("id", "path", "shape")).where("shape is not null"), "shapes")
    depth = kept.agg(F.max(F.size("path"))).first()[0] or 0
    done = kept.where(F.col("json").isNotNull()).select("id", "path", "parent", "key", "pos", "json")
    outer = kept.where(F.col("json").isNull()).select("id", "path", "parent", "key", "pos")
    top = roots.where("json is not null").select("id", "json")
    for size in range(depth, 0, -1):
        part = F.when(F.col("key").isNull(), F.col("json")).otherwise(F.concat(quoted(F.col("key")), F.lit(":"), F.col("json")))
        ready = done.where(F.size("path") == size).groupBy("id", F.col("parent").alias("path"))
        inside = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "pos", part.alias("part")))), lambda p: p["part"]), ",")
        made = ready.agg(inside.alias("inside")).join(shapes, NODE)
        made = made.select(*NODE, F.concat(F.substring("shape", 1, 1), F.col("inside"), F.substring("shape", 2, 1)).alias("json"))
        if size == 1:
            return made.select("id", "json").unionByName(top)
        made = made.join(outer, NODE).select("id", "path", "parent", "key", "pos", "json")
        done = written(done.where(F.size("path") < size).unionByName(made), "done")
    return top


def translated(docs: DataFrame, translate) -> DataFrame:
    """(id, json) of documents (id, value variant) after all their items are translated: ``translate`` takes a table of
    distinct texts (text) and returns (text, en)."""
    found = nodes(docs)
    return put_back(found, translate(untranslated(found).select("text").distinct()))


def parsed(spark: SparkSession, docs: DataFrame, json: str = "json") -> DataFrame:
    """Documents (id, value) from a column of JSON; null where it is none."""
    return docs.select("id", F.try_parse_json(F.col(json)).alias("value"))
