"""Collapse of logged conversation snapshots, and chat rendering, with built-in functions only.

A log often holds one conversation many times, each a few turns longer. Rolling hashes of
turn prefixes (two 64-bit lanes; a turn's hash holds its position, so a running xor keeps
the order) tell which conversations are a prefix of a longer one; an anti-join drops
those, and of equal conversations the smallest conv_id stays. What is left is rendered
with role tags.

Positions and running hashes are taken in blocks of ``BLOCK`` turn numbers, then moved
by the sums of the blocks before, so a conversation of any length is no single group.

Defined results: a turn with null role or text differs from one with an empty one and is
rendered as empty; null turn numbers come first; equal turn numbers are ordered by role,
then text; repeated rows are turns of their own; rows with null conv_id are dropped, as
they belong to no conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stagewise.llm.common import stored

BLOCK = 1024


def turns_of(df: DataFrame) -> DataFrame:
    """conv_id, position (from 0), role, text and rolling hashes of every turn."""
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).where("conv_id is not null")
    rows = rows.withColumn("block", F.floor(F.coalesce("turn", F.lit(-(2**40))) / BLOCK))
    within = W.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    rows = rows.withColumn("at", (F.row_number().over(within) - 1).cast("long"))
    sizes = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("moved"))
    rows = rows.join(sizes, ["conv_id", "block"])
    rows = rows.withColumn("position", F.col("at") + F.col("moved"))
    content = [F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    rows = rows.withColumn("turn_a", F.xxhash64("position", *content)).withColumn("turn_b", F.xxhash64(F.lit("b"), *content, "position"))
    running = within.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({f"run_{x}": F.bit_xor(f"turn_{x}").over(running) for x in "ab"})
    blocks = rows.groupBy("conv_id", "block").agg(*[F.bit_xor(f"turn_{x}").alias(f"block_{x}") for x in "ab"])
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"block_{x}").over(before), F.lit(0)).alias(f"past_{x}") for x in "ab"])
    rows = rows.join(blocks, ["conv_id", "block"])
    return rows.select("conv_id", "position", "role", "text", *[F.col(f"run_{x}").bitwiseXOR(F.col(f"past_{x}")).alias(f"prefix_{x}") for x in "ab"])


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of the conversations that are no prefix of a longer one."""
    length = F.max(F.struct("position", "prefix_a", "prefix_b")).alias("end")
    whole = turns.groupBy("conv_id").agg(length).select("conv_id", "end.*")
    keys = ["position", "prefix_a", "prefix_b"]
    unique = whole.groupBy(*keys).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    ends = unique.select("conv_id", F.col("position").alias("last"))
    inner = turns.join(ends, "conv_id").where("position < last").select(*keys).distinct()
    return unique.join(inner, keys, "left_anti").select("conv_id", (F.col("position") + 1).alias("n_turns"), "n_copies")


def render(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One chat text per conversation, turns in order."""
    line = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>"))
    parts = turns.join(conversations, "conv_id").groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("lines"))
    return parts.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("chat"))


def collapse_snapshots(df: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and chat of every maximal conversation."""
    turns = stored(turns_of(df), "turns")
    return render(turns, maximal(turns))


ORACLE = """
WITH numbered AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
marked AS (
  SELECT conv_id, place,
         CASE WHEN role IS NULL THEN 'n' ELSE 'r' || length(role) || ':' || role END ||
         CASE WHEN text IS NULL THEN 'n' ELSE 't' || length(text) || ':' || text END AS mark,
         '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' AS line
  FROM numbered),
prefixes AS (
  SELECT conv_id, place, string_agg(mark, '/') OVER (PARTITION BY conv_id ORDER BY place) AS prefix,
         max(place) OVER (PARTITION BY conv_id) AS size
  FROM marked),
whole AS (
  SELECT min(conv_id) AS conv_id, size, prefix, count(*) AS n_copies
  FROM prefixes WHERE place = size GROUP BY size, prefix),
longest AS (
  SELECT * FROM whole w
  WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.place = w.size AND p.size > w.size AND p.prefix = w.prefix))
SELECT l.conv_id, CAST(l.size AS BIGINT) AS n_turns, CAST(l.n_copies AS BIGINT) AS n_copies,
       string_agg(m.line, chr(10) ORDER BY m.place) AS chat
FROM longest l JOIN marked m ON m.conv_id = l.conv_id
GROUP BY l.conv_id, l.size, l.n_copies
"""
