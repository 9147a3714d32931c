"""Chat formatting: cumulative snapshots of a conversation collapse to the longest one before rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: What stands before a turn (with its role) and after it in a rendered conversation.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turn_digest(seed: int) -> Column:
    """A hash of a turn at its place; null and empty parts differ."""
    return F.xxhash64(F.lit(seed), F.col("place"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))


def prefix_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, h1, h2, n): turns with their place in the conversation (from 0), the hash of all turns
    up to them, and the turns of the conversation.

    The rolling hash of a prefix is the sum, modulo 2**64, of its turns' hashes at their places, in two independent lanes.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.xxhash64("role", "text"), "role", "text")
    placed = turns.withColumn("place", F.row_number().over(order) - 1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("d1", turn_digest(1)).withColumn("d2", turn_digest(2))
    # Halves of the hashes are added apart, so that sums never overflow.
    low, high = (lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))), (lambda c: F.shiftrightunsigned(c, 32))
    lanes = {f"{p}{i}": F.sum(f(f"d{i}")).over(upto) for i in (1, 2) for p, f in (("l", low), ("u", high))}
    return (
        placed.withColumns(lanes)
        .withColumn("h1", F.xxhash64("l1", "u1"))
        .withColumn("h2", F.xxhash64("l2", "u2"))
        .withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
        .select("conv_id", "place", "role", "text", "h1", "h2", "n")
    )


def maximal_conversations(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, n_turns, text): the conversations that are a prefix of no longer one and equal none with a smaller
    conv_id, rendered.

    A turn is its role and text; turns are ordered by ``turn`` (nulls first), ties by content. Turns without a conv_id
    belong to no conversation and are left out. A null role or text differs from an empty one and is rendered as empty.
    Repeated rows are turns of their own. Other columns are ignored; an empty table gives an empty result.
    """
    turns = conversations.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    ).where("conv_id is not null")
    turns = cut(prefix_digests(turns), "turns")
    last = turns.where("place = n - 1")
    # One conversation for each content, and one row for each proper prefix: no key is hot in the anti-join.
    whole = last.groupBy("h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    inner = turns.where("place < n - 1").select("h1", "h2").distinct()
    kept = cut(whole.join(inner, ["h1", "h2"], "left_anti").select("conv_id"), "maximal")
    said = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n"))
    return (
        turns.join(kept, "conv_id", "left_semi")
        .groupBy("conv_id")
        .agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("place", said.alias("said")))).alias("said"))
        .select(F.col("conv_id").alias(conv), "n_turns", F.array_join("said.said", "").alias("text"))
    )


def op2_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal conversations of the whole table; nulls, ties and empty tables as :func:`maximal_conversations` says."""
    return maximal_conversations(table(spark, sf_dir, "conversations"))


OP2_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS said
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(said, '' ORDER BY turn) AS text FROM t GROUP BY conv_id),
f AS (SELECT conv_id, arg_min(said, turn) AS opening FROM t GROUP BY conv_id),
d AS (SELECT c.*, f.opening FROM c JOIN f USING (conv_id))
SELECT conv_id, n_turns, text FROM d a
WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.opening = a.opening AND b.conv_id <> a.conv_id
                  AND ((b.n_turns > a.n_turns AND starts_with(b.text, a.text)) OR (b.text = a.text AND b.conv_id < a.conv_id)))
"""
