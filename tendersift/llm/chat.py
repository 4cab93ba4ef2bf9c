"""Chat formatting by multi-party perspective rotation, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered with that speaker as ``assistant`` and all other
speakers as named users. The rows are single turns with their place in the rendered text: the segments of one
(conv_id, perspective) in order of ``start`` are the text, and ``loss_start``/``loss_end`` bound the characters
that are trained on (what the perspective says and its end mark; null elsewhere).

Defined cases: ``system`` is no participant and stays ``system``; a null role is a speaker called ``unknown``; a
null text is empty; rows that repeat in all four columns count once; turns go by number (null first), then role,
then text; a null conv_id is one conversation. ``<|`` in a text or a role becomes ``< |``, and in a name %, blanks, tabs, line
ends and = are written as %25, %20, %09, %0A, %0D and %3D, so neither can forge a mark or a header. An
empty table gives no rows; a conversation of system turns only gives none.

A conversation may hold most of the rows, so none is gathered: participants are distinct (conv_id, role) pairs,
the join on the conversation can be split by the skew rule, and places are sums of segment lengths over blocks
of turns, then inside a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tendersift.llm.common import prepare, table

OPEN, CLOSE, BLOCK = "<|im_start|>", "<|im_end|>", 256


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


#: What a name may not hold, and how it is written there.
ESCAPED = {"%": "%25", " ": "%20", "\t": "%09", "\n": "%0A", "\r": "%0D", "=": "%3D", "<|": "%3C%7C"}


def _name(speaker: Column) -> Column:
    for found, written in ESCAPED.items():
        speaker = F.replace(speaker, F.lit(found), F.lit(written))
    return speaker


def rotate(turns: DataFrame) -> DataFrame:
    prepare(turns.sparkSession)
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"),
                        F.coalesce("text", F.lit("")).alias("said")).distinct()
    people = (turns.select(F.col("conv_id").alias("conv"), F.coalesce("role", F.lit("unknown")).alias("perspective"))
              .where("perspective <> 'system'").distinct())
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == "system", "system").when(own, "assistant").otherwise("user")
    name = F.when(F.col("role") == "user", _name(F.col("speaker")))
    rows = (said.join(people, said.conv_id.eqNullSafe(people.conv))
            .withColumn("role", role).withColumn("name", name)
            .withColumn("head", F.concat(F.lit(OPEN), "role", F.coalesce(F.concat(F.lit(" name="), "name"), F.lit("")), F.lit("\n")))
            .withColumn("segment", F.concat("head", _safe(F.col("said")), F.lit(CLOSE + "\n")))
            .withColumn("block", F.floor(F.col("turn") / BLOCK)))
    key = ["conv_id", "perspective"]
    size = F.length("segment")
    blocks = rows.groupBy(*key, "block").agg(F.sum(size).alias("chars"))
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("b_conv"), F.col("perspective").alias("b_person"), F.col("block").alias("b_block"),
                           F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy(*key, "block").orderBy("turn", "speaker", "said").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum(size).over(inner), F.lit(0))).join(
        blocks, F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("perspective") == F.col("b_person"))
        & F.col("block").eqNullSafe(F.col("b_block")))
    start = F.col("base") + F.col("inside")
    speaks = F.col("speaker") == F.col("perspective")
    return placed.select(
        "conv_id", "perspective", "turn", "role", "name", "segment", start.alias("start"),
        F.when(speaks, start + F.length("head")).alias("loss_start"),
        F.when(speaks, start + size - 1).alias("loss_end"))


def dialogues(rotated: DataFrame, max_chars: int = 65536) -> DataFrame:
    """Rendered texts of at most about ``max_chars`` characters (whole turns) with their loss spans.

    Part ``k`` holds the segments that start in its range, so a group is bounded however long the conversation.
    """
    part = F.floor(F.col("start") / max_chars)
    turn = F.struct("start", "segment", "loss_start", "loss_end")
    grouped = rotated.groupBy("conv_id", "perspective", part.alias("part")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    first = F.col("t")[0]["start"]
    spans = F.transform(F.filter("t", lambda x: x["loss_start"].isNotNull()),
                        lambda x: F.struct((x["loss_start"] - first).alias("start"), (x["loss_end"] - first).alias("end")))
    return grouped.select("conv_id", "perspective", "part", F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("text"),
                          spans.alias("loss_spans"))


def op8_chat(spark, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


_NAME_SQL = "speaker"
for _found, _written in ESCAPED.items():
    _NAME_SQL = f"replace({_NAME_SQL}, {' || '.join(f'chr({ord(c)})' for c in _found)}, '{_written}')"
OP8_SQL = f"""
WITH said AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS said FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
r0 AS (SELECT s.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
r1 AS (SELECT *, CASE WHEN role = 'user' THEN {_NAME_SQL} END AS name FROM r0),
r2 AS (SELECT *, '{OPEN}' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM r1),
r3 AS (SELECT *, head || replace(said, '<|', '< |') || '{CLOSE}' || chr(10) AS segment FROM r2),
r4 AS (SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, said
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM r3)
SELECT conv_id, perspective, turn, role, name, segment, start,
  CASE WHEN speaker = perspective THEN start + length(head) END AS loss_start,
  CASE WHEN speaker = perspective THEN start + length(segment) - 1 END AS loss_end FROM r4
"""
