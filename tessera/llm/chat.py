"""Operator 7: chat formatting after cumulative-snapshot collapse, in DataFrame functions only.

Chat logs often store a conversation again after every turn. A rolling hash of each turn prefix (a running sum of two seeded 64-bit
hashes of turn number, role and text, so that it can be computed in pieces) tells which logged conversations are
a prefix of a longer one. Those are removed by an anti-join; of equal conversations the smallest conv_id stays. The turns of
the conversations that are left are rendered.

A conversation may hold a third of all rows: turns are dealt by ranges of (conv_id, turn), summed within each range, and the sums
of the ranges before are added, so no task needs a whole conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, table, written

START, END = "<|im_start|>", "<|im_end|>"


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, turn -> h1, h2: hashes of all turns of the conversation up to and with this turn number; has_next: a later one follows.

    Rows that repeat a turn number belong to it together; their order does not matter.
    """
    n = shuffle_partitions(turns.sparkSession)
    # exact sums without overflow: each hash is reduced to 56 bits, its sum kept as decimal
    h = lambda seed: F.sum(F.pmod(F.xxhash64(F.lit(seed), "turn", "role", "text"), F.lit((1 << 56) - 5)).cast("decimal(20,0)"))
    per_turn = turns.groupBy("conv_id", "turn").agg(h(1).alias("h1"), h(2).alias("h2"), F.count("*").alias("n"))
    dealt = written(per_turn.repartitionByRange(n, "conv_id", "turn").withColumn("part", F.spark_partition_id()), "turns")
    sums = dealt.groupBy("conv_id", "part").agg(F.sum("h1").alias("s1"), F.sum("h2").alias("s2"), F.max("turn").alias("last"))
    w = Window.partitionBy("conv_id").orderBy("part")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("conv_id", "part", F.coalesce(F.sum("s1").over(before), F.lit(0)).alias("b1"), F.coalesce(F.sum("s2").over(before), F.lit(0)).alias("b2"), F.lead("last").over(w).isNotNull().alias("more"))
    within = Window.partitionBy("conv_id", "part").orderBy("turn")
    run = dealt.withColumns({"r1": F.sum("h1").over(within), "r2": F.sum("h2").over(within), "follows": F.lead("n").over(within).isNotNull()})
    joined = run.join(carried.withColumnsRenamed({"conv_id": "c", "part": "p"}), (F.col("conv_id") == F.col("c")) & (F.col("part") == F.col("p")))
    return joined.select("conv_id", "turn", (F.col("r1") + F.col("b1")).alias("h1"), (F.col("r2") + F.col("b2")).alias("h2"), (F.col("follows") | F.col("more")).alias("has_next"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id of the conversations that are neither a prefix of a longer one nor a copy of one with a smaller conv_id."""
    prefixes = turn_prefixes(turns)
    ends = prefixes.filter("not has_next").groupBy("turn", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    passed = prefixes.filter("has_next").groupBy("turn", "h1", "h2").agg(F.count("*").alias("n")).drop("n")
    return ends.join(passed, ["turn", "h1", "h2"], "left_anti").select("conv_id")


def format_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, rendered: the turns of the maximal conversations as chat-template text, to be joined in turn order.

    Rows without a conv_id or turn belong to no conversation and are left out; a null role is `unknown`, a null text empty.
    Rows that are repeated as a whole count once. Other columns are not read; an empty table gives no rows.
    """
    turns = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    turns = turns.filter("conv_id is not null and turn is not null").distinct()
    kept = turns.join(maximal_conversations(turns), "conv_id", "left_semi")
    return kept.select("conv_id", "turn", F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END + "\n")).alias("rendered"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


ORACLE_SQL = f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), g AS (SELECT conv_id, turn, list(role || chr(0) || text ORDER BY role, text) AS rows FROM t GROUP BY conv_id, turn),
p AS (
  SELECT conv_id, turn, list((turn, rows)) OVER (PARTITION BY conv_id ORDER BY turn) AS prefix, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS ends FROM g
), e AS (SELECT prefix, min(conv_id) AS conv_id FROM p WHERE ends GROUP BY prefix),
m AS (SELECT conv_id FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE NOT p.ends AND p.prefix = e.prefix))
SELECT t.conv_id, t.turn, '{START}' || role || chr(10) || text || '{END}' || chr(10) AS rendered FROM t SEMI JOIN m ON t.conv_id = m.conv_id
"""
