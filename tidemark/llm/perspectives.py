"""Multi-party perspective rotation, in DataFrame functions only.

Every dialogue is rendered once for each participant: that speaker's turns as the assistant, all others as
named users, and a mask that marks what the assistant says. A row is one turn of one rendering, with its text
and its place in the rendering in code points, so that the rows of a rendering in order make up the dialogue
however long it is. Dialogues are dealt by stretches of ``stretch`` turn numbers, whose totals are aggregated
first, so a dialogue of any length is spread over tasks, and each text moves once.

Turns are in the order of (turn, role, text). A null role is the speaker "unknown", a null text is empty, a null
turn comes first, and rows without conv_id are one dialogue. Repeated rows are turns of their own. Extra
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import table

ASSISTANT_HEAD, USER_HEAD, USER_END, TURN_END = "<|assistant|>\n", "<|user:", "|>\n", "<|end|>\n"
STRETCH = 1024
NO_CONVERSATION, NO_TURN = -(2**63), -(2**62)


def rotate(conversations: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """A row per conversation, participant and turn."""
    turns = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_CONVERSATION)).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("content"),
    )
    turns = turns.withColumn("stretch", F.floor(F.coalesce("turn", F.lit(NO_TURN)) / stretch).cast("long"))
    as_user = F.length(F.concat(F.lit(USER_HEAD), "speaker", F.lit(USER_END)))
    as_assistant = len(ASSISTANT_HEAD)
    width = F.length("content") + len(TURN_END)

    light = turns.groupBy("conv", "stretch", "speaker").agg(F.count("*").alias("n"), F.sum(as_user + width).alias("chars"))
    people = light.select("conv", F.col("speaker").alias("participant")).distinct()
    totals = light.groupBy("conv", "stretch").agg(F.sum("chars").alias("chars"), F.map_from_entries(F.collect_list(F.struct("speaker", "n"))).alias("by"))
    totals = totals.join(people, "conv").withColumn("own", F.coalesce(F.element_at("by", F.col("participant")), F.lit(0)))
    before = Window.partitionBy("conv", "participant").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    saved = as_assistant - F.length(F.concat(F.lit(USER_HEAD), "participant", F.lit(USER_END)))
    base = F.coalesce(F.sum(F.col("chars") + saved * F.col("own")).over(before), F.lit(0))
    seen = F.coalesce(F.sum(F.aggregate(F.map_values("by"), F.lit(0).cast("long"), lambda a, x: a + x)).over(before), F.lit(0))
    totals = totals.select("conv", "stretch", "participant", base.alias("base"), seen.alias("seen"))

    rendered = turns.join(totals, ["conv", "stretch"])
    mine = F.col("speaker") == F.col("participant")
    head = F.when(mine, F.lit(ASSISTANT_HEAD)).otherwise(F.concat(F.lit(USER_HEAD), "speaker", F.lit(USER_END)))
    rendered = rendered.withColumn("head", head).withColumn("size", F.length("head") + width)
    upto = Window.partitionBy("conv", "stretch", "participant").orderBy("turn", "speaker", "content").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("base") + F.sum("size").over(upto)
    rendered = rendered.withColumn("end", end).withColumn("message", F.col("seen") + F.count("*").over(upto) - 1)
    start = F.col("end") - F.col("size")
    return rendered.select(
        F.when(F.col("conv") != NO_CONVERSATION, F.col("conv")).alias("conv_id"),
        "participant", "message", "turn",
        F.when(mine, F.lit("assistant")).otherwise(F.lit("user")).alias("role"),
        F.when(~mine, F.col("speaker")).alias("name"),
        F.concat("head", "content", F.lit(TURN_END)).alias("rendered"),
        start.alias("start"), F.col("end"),
        mine.cast("int").alias("mask"),
        F.when(mine, start + F.length("head")).alias("mask_start"),
        F.when(mine, F.col("end")).alias("mask_end"),
    )


def op6(spark, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's side."""
    return rotate(table(spark, sf_dir, "conversations"))


QUERIES = {"op6_perspective_rotation": op6}
ORACLES = {
    "op6_perspective_rotation": """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS content FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS participant FROM t),
j AS (
  SELECT t.*, p.participant, t.speaker = p.participant AS mine,
    CASE WHEN t.speaker = p.participant THEN '<|assistant|>' || chr(10) ELSE '<|user:' || t.speaker || '|>' || chr(10) END AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
r AS (SELECT *, head || content || '<|end|>' || chr(10) AS rendered FROM j),
s AS (
  SELECT *, CAST(sum(length(rendered)) OVER w AS BIGINT) AS "end", row_number() OVER w - 1 AS message FROM r
  WINDOW w AS (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, speaker, content ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, participant, message, turn, CASE WHEN mine THEN 'assistant' ELSE 'user' END AS role,
  CASE WHEN NOT mine THEN speaker END AS name, rendered, "end" - length(rendered) AS start, "end",
  CAST(mine AS INTEGER) AS mask,
  CASE WHEN mine THEN "end" - length(rendered) + length(head) END AS mask_start,
  CASE WHEN mine THEN "end" END AS mask_end
FROM s"""
}
