"""Operator 10: chat formatting with cumulative-snapshot collapse.

A logged conversation is often a snapshot of one that went on. Every turn gets the rolling hash of all turns up to it;
a conversation whose last hash is the hash of an earlier turn of another one is a prefix of that one and goes, by an
anti-join against the distinct hashes of non-final turns. Of equal conversations the smallest conv_id stays. What is
left is rendered in a template of marked turns. Hashes are reduced to one row each before they meet, so that a turn or
conversation that many rows share costs no more than one that few share.

Turns are ordered by turn, then role, then text. Rows without conv_id or turn belong to no conversation and are left
out; a null role or text counts as empty; a repeated row counts once; turns that share a number all stay. Markers of the
template inside a text are broken by a blank. Extra columns are ignored, an empty table gives an empty table. A
conversation is one row of the result, hence its own turns (not those of its copies) meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, hashes): the ordered turns of each conversation and their rolling hashes.

    A turn's hash is of the running sums of two 64-bit hashes of the turns up to it, their places included; so a
    conversation takes time in proportion to its turns.
    """
    clean = turns.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = clean.distinct().withColumn("place", F.row_number().over(order))
    so_far = [F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("string") for columns in (("place", "role", "text"), ("text", "place", "role"))]
    hashed = placed.withColumn("hash", F.unhex(F.md5(F.concat_ws(":", F.col("place").cast("string"), *so_far))))
    grouped = hashed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text", "hash"))).alias("turns"))
    return grouped.select("conv_id", "turns", F.col("turns.hash").alias("hashes"))


def maximal(convs: DataFrame) -> DataFrame:
    """The rows of `convs` that are no proper prefix of another, the smallest conv_id of equal ones."""
    last = convs.groupBy(F.element_at("hashes", -1).alias("hash")).agg(F.min("conv_id").alias("conv_id"))
    earlier = convs.select(F.explode(F.slice("hashes", 1, F.size("hashes") - 1)).alias("hash")).distinct()
    return convs.join(last.join(earlier, "hash", "left_anti").select("conv_id"), "conv_id", "left_semi")


def rendered(turns: Column) -> Column:
    def turn(t: Column) -> Column:
        role, text = (F.replace(t[c], F.lit("<|im_"), F.lit("<| im_")) for c in ("role", "text"))
        return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))

    return F.array_join(F.transform(turns, turn), "")


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_assistant, chat) of the maximal conversations in `turns` (conv_id, turn, role, text)."""
    assistant = F.size(F.filter("turns", lambda t: t["role"] == "assistant"))
    return maximal(conversations(turns)).select("conv_id", F.size("turns").cast("long").alias("n_turns"), assistant.cast("long").alias("n_assistant"), rendered(F.col("turns")).alias("chat"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


SQL = """
WITH clean AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n FROM clean),
prefixes AS (
  SELECT *, string_agg(length(role) || ':' || role || length(text) || ':' || text, '')
            OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS prefix FROM numbered),
kept AS (
  SELECT min(conv_id) AS conv_id FROM prefixes WHERE k = n
    AND prefix NOT IN (SELECT prefix FROM prefixes WHERE k < n) GROUP BY prefix)
SELECT conv_id, count(*) AS n_turns, count(*) FILTER (WHERE role = 'assistant') AS n_assistant,
       string_agg('<|im_start|>' || replace(role, '<|im_', '<| im_') || chr(10) || replace(text, '<|im_', '<| im_')
                  || '<|im_end|>' || chr(10), '' ORDER BY k) AS chat
FROM numbered WHERE conv_id IN (SELECT conv_id FROM kept) GROUP BY conv_id
"""
