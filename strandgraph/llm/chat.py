"""Chat formatting with cumulative-snapshot collapse.

A chat log often holds a conversation again and again as it grows. A rolling hash of
128 bits runs over the turns of each conversation: the sum of the hashes of (position,
turn) up to each turn. A conversation is a prefix of another if its last hash is among
the other's. An anti-join removes conversations that are a proper prefix of a longer one;
of equal ones the smallest id stays. Those that remain are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table

START, END = "<|im_start|>", "<|im_end|>"


def prefix_hashes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, position (from 1), n_turns, role, text, hash of the turns up to this one (two sums of 64-bit hashes).

    Turns are ordered by turn number, role and text; nulls come first. A null role or text is part of
    the hash and differs from an empty one. Rows with a null conversation belong to none and are
    left out. A repeated row is a turn of its own. Texts may be of any length: a turn's hash reads them
    once, and each turn adds to a running sum, so long conversations take linear time.
    """
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    own = F.sha2(F.to_json(F.struct(F.octet_length("role").alias("r"), F.octet_length("text").alias("t"))), 256)
    own = F.sha2(F.concat(own, F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))), 256)
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    rows = rows.withColumn("own", own).withColumn("position", F.row_number().over(order))
    # Sums of 64-bit numbers in 38 digits don't overflow below 2^62 turns.
    part = lambda seed: F.xxhash64(F.lit(seed), "own", "position").cast("decimal(38,0)")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("a", F.sum(part(1)).over(running)).withColumn("b", F.sum(part(2)).over(running))
    return summed.select("conv", "position", F.count("*").over(Window.partitionBy("conv")).cast("int").alias("n_turns"), "role", "text", F.concat_ws(",", "a", "b").alias("hash"))


def maximal_conversations(hashes: DataFrame) -> DataFrame:
    """conv, n_turns, n_collapsed of the conversations that prefix no longer one; n_collapsed counts those equal to it."""
    # Equal conversations and equal prefixes are gathered before the two sides meet, so that each hash is there once.
    full = hashes.where("position = n_turns").groupBy("hash").agg(F.min("conv").alias("conv"), F.first("n_turns").alias("n_turns"), (F.count("*") - 1).alias("n_collapsed"))
    longer = hashes.where("position < n_turns").select("hash").distinct()
    return full.join(longer, "hash", "left_anti").drop("hash")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_collapsed, rendered.

    A null role is rendered as an empty one, a null text as no text. An empty table gives an empty
    result; further columns are not looked at. Only kept conversations are gathered, each in one text.
    """
    hashes = checkpoint(prefix_hashes(turns, conv_col, turn_col, role_col, text_col))
    kept = maximal_conversations(hashes)
    turn_text = F.concat(F.lit(START), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END), F.lit("\n"))
    return (
        hashes.select("conv", "position", turn_text.alias("t")).join(kept, "conv")
        .groupBy("conv", "n_turns", "n_collapsed")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "t"))), lambda x: x["t"]), "").alias("rendered"))
        .withColumnRenamed("conv", conv_col)
    )


def op6_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


QUERIES = {"op6_snapshot_collapse": op6_snapshot_collapse}
SQL = {
    "op6_snapshot_collapse": r"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(md5(coalesce(length(role)::VARCHAR, '-') || '|' || coalesce(role, '') || '|' || coalesce(text, '-null-')) ORDER BY i) AS t,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY i) AS rendered FROM n GROUP BY conv_id)
SELECT min(a.conv_id) AS conv_id, len(a.t)::INT AS n_turns, count(*) - 1 AS n_collapsed, a.rendered
FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.t[1] = a.t[1] AND len(b.t) > len(a.t) AND b.t[1:len(a.t)] = a.t)
GROUP BY a.t, a.rendered
"""
}
