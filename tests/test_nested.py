"""Text items in nested documents."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import nested


def model(value):
    """The document after every item without ``en`` has got one."""
    if isinstance(value, dict):
        out = {k: model(v) for k, v in value.items()}
        if isinstance(value.get("uk"), str) and "en" not in value:
            out["en"] = value["uk"].upper()
        return out
    return [model(v) for v in value] if isinstance(value, list) else value


DOCS = [
    {"uk": "a"},
    {"uk": "a", "en": None},
    {"uk": "a", "en": "done"},
    {"uk": None},
    {"uk": 5, "x": {"uk": ""}},
    [[{"uk": "deep"}, []], {}, [{"k": [{"uk": 'q"\\\n', "b": [1, 2.5, True, None]}]}]],
    {"b": {"c": {"d": {"e": {"uk": "a"}}}}, "a": [{"uk": "a"}] * 3, "_": {"uk": {"uk": "inner"}}},
    "text",
    7,
    None,
    [],
    {},
]


def test_any_shape(spark):
    docs = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCS)] + [(99, "no json"), (98, None)], "id int, json string")
    parsed = nested.parsed(spark, docs)
    asked = []

    def translate(texts):
        asked.extend(r.text for r in texts.collect())
        return texts.select("text", F.upper("text").alias("en"))

    got = {r.id: json.loads(r.json) for r in nested.translated(parsed, translate).collect()}
    assert got == {i: model(d) for i, d in enumerate(DOCS)}
    assert sorted(asked) == sorted({"a", "", "deep", 'q"\\\n', "inner"})


def test_places(spark):
    docs = nested.parsed(spark, spark.createDataFrame([(1, json.dumps(DOCS[5]))], "id int, json string"))
    found = nested.nodes(docs).where("text is not null").select(nested.place(F.col("steps")).alias("p"), "path").collect()
    assert {(r.p, tuple(r.path)) for r in found} == {("[0,0]", (0, 0)), ('[2,0,"k",0]', (2, 0, 0, 0))}


@pytest.mark.parametrize("known", [[], [("a", None)], [("a", "x"), ("a", "y")]])
def test_missing_and_repeated_translations(spark, known):
    docs = nested.parsed(spark, spark.createDataFrame([(1, '{"uk":"a"}'), (2, '{"t":{"uk":"b"}}')], "id int, json string"))
    table = spark.createDataFrame(known, "text string, en string")
    got = {r.id: r.json for r in nested.put_back(nested.nodes(docs), table).collect()}
    assert got == {1: '{"en":"x","uk":"a"}' if len(known) > 1 else '{"uk":"a"}', 2: '{"t":{"uk":"b"}}'}


def test_empty_table(spark):
    docs = nested.parsed(spark, spark.createDataFrame([], "id int, json string"))
    assert nested.translated(docs, lambda t: t.selectExpr("text", "text as en")).count() == 0
