"""Nested documents: text items found at any depth, translated once each and put back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nested
from .registry import query, table


def conversations(spark, sf_dir):
    """(id, json): a nested document for each conversation; every third turn has its translation."""
    text = F.coalesce("text", F.lit(""))
    item = F.struct(F.when(F.col("turn") % 3 == 0, "done").alias("en"), text.alias("uk"))
    turn = F.struct("role", F.array(item).alias("texts"))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", text.alias("text"), turn.alias("shown")))).alias("turns")
    )
    title = F.struct(F.lit(None).cast("string").alias("en"), F.concat(F.lit("Talk "), (F.col("conv_id") % 7).cast("string")).alias("uk"))
    whole = F.struct(F.struct(title.alias("title")).alias("about"), F.transform("turns", lambda t: t["shown"]).alias("turns"))
    return turns.select(F.col("conv_id").alias("id"), F.to_json(whole).alias("json"))


@query(
    """WITH t AS (SELECT conv_id, list({'role': role, 'texts': [{'en': CASE WHEN turn % 3 = 0 THEN 'done' ELSE 'EN:' || coalesce(text, '') END, 'uk': coalesce(text, '')}]} ORDER BY turn, role, coalesce(text, '')) AS turns FROM conversations GROUP BY conv_id)
SELECT conv_id AS id, CAST(to_json({'about': {'title': {'en': 'EN:Talk ' || conv_id % 7, 'uk': 'Talk ' || conv_id % 7}}, 'turns': turns}) AS VARCHAR) AS json FROM t"""
)
def q_nested_translate(spark, sf_dir):
    """Items three levels deep: gathered by path, each text translated once, put back."""
    docs = nested.parsed(spark, conversations(spark, sf_dir))
    return nested.translated(docs, lambda texts: texts.select("text", F.concat(F.lit("EN:"), "text").alias("en")))


@query(
    """SELECT conv_id AS id, CASE WHEN turn IS NULL THEN '["about","title"]' ELSE '["turns",' || nth || ',"texts",0]' END AS place,
 CASE WHEN turn IS NULL THEN 'Talk ' || conv_id % 7 ELSE coalesce(text, '') END AS text FROM
 (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, coalesce(text, '')) - 1 AS nth FROM conversations UNION ALL SELECT DISTINCT conv_id, NULL, NULL, NULL FROM conversations)
WHERE turn IS NULL OR turn % 3 <> 0"""
)
def q_nested_gather(spark, sf_dir):
    """Where untranslated items are, with the names and positions that lead to them."""
    found = nested.nodes(nested.parsed(spark, conversations(spark, sf_dir)))
    return found.where("text is not null").select("id", nested.place(F.col("steps")).alias("place"), "text")
