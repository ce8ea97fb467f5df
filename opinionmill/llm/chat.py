"""Chat formatting by perspective rotation.

For every participant of a dialogue the dialogue is rendered once more with that speaker as the assistant and
everyone else as a named user; only the assistant's own words are learned from.  A rendered turn is

    <|im_start|>assistant\\n TEXT <|im_end|>\\n          (the speaker)
    <|im_start|>user name=NAME\\n TEXT <|im_end|>\\n     (anyone else)
    <|im_start|>system\\n TEXT <|im_end|>\\n             (the role ``system``, which is nobody's perspective)

A rendering is kept as one row per turn with its place in the whole, so a dialogue of any length is spread over
the cluster; joining the rows by ``position`` gives the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Turn marks.
START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"


def escaped(text: Column) -> Column:
    """Marks inside a text are broken up, so that a text can't end its own turn."""
    return F.replace(F.replace(text, F.lit(START), F.lit("<|im_ start|>")), F.lit(END), F.lit("<|im_ end|>"))


def rotate_perspectives(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per dialogue, speaker and turn.

    ``conv_id, speaker, position`` (from 0), ``turn, role`` (assistant, user or system), ``name`` (of a user),
    ``rendered``, ``start_char, end_char`` (of the rendered turn in the whole, code points), ``mask_start,
    mask_end`` (the learned part: text and end mark of the speaker's own turns; else null).

    Turns are ordered by number, role and text; equal rows stay as often as they stand there.  A null turn number
    comes first, a null role is the speaker ``unknown``, a null text is empty, rows without a dialogue id are one
    dialogue.  A dialogue of the system alone has no perspective.  Other columns are ignored; an empty
    table gives no row; texts of any length stay whole.

    Places are sums over all earlier turns.  They are added up per range of the sorted turns first and then over
    the ranges, so a dialogue with a third of all turns is no task's burden.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("speaking"),
        F.coalesce(escaped(F.col(text_col)), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    order = ["conv_id", "turn", "speaking", "text", "_tie"]
    # Ranges are fixed by a sample, so they are written down before anything is derived from them.
    ranged = cut_lineage(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))

    speakers = (
        ranged.where(F.col("speaking") != SYSTEM)
        .select(F.col("conv_id").alias("_conv"), F.col("speaking").alias("speaker"))
        .distinct()
    )
    body = F.concat(F.col("text"), F.lit(END + "\n"))
    own = F.col("speaking") == F.col("speaker")
    head = F.concat(
        F.lit(START),
        F.when(F.col("speaking") == SYSTEM, F.lit(SYSTEM))
        .when(own, F.lit("assistant"))
        .otherwise(F.concat(F.lit("user name="), F.col("speaking"))),
        F.lit("\n"),
    )
    views = ranged.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        *order,
        "_range",
        "speaker",
        F.concat(head, body).alias("rendered"),
        F.when(own, F.length(head)).alias("_head"),
    )
    part = ["conv_id", "speaker", "_range"]
    size = F.length("rendered").cast("long")
    # Turns and characters of each range, then of all ranges before it.
    ranges = views.groupBy(*part).agg(F.count("*").alias("_turns"), F.sum(size).alias("_chars"))
    before = Window.partitionBy("conv_id", "speaker").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(
        *(F.col(c).alias(f"r_{c}") for c in part),
        F.coalesce(F.sum("_turns").over(before), F.lit(0)).alias("_turns"),
        F.coalesce(F.sum("_chars").over(before), F.lit(0)).alias("_chars"),
    )
    within = Window.partitionBy(*part).orderBy("turn", "speaking", "text", "_tie")
    placed = views.select(
        "*",
        (F.row_number().over(within) - 1).alias("_place"),
        (F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, 0)) - size).alias("_at"),
    ).join(
        offsets,
        F.col("conv_id").eqNullSafe(F.col("r_conv_id")) & (F.col("speaker") == F.col("r_speaker")) & (F.col("_range") == F.col("r__range")),
    )
    start = F.col("_chars") + F.col("_at")
    stop = start + size
    return placed.select(
        "conv_id",
        "speaker",
        (F.col("_turns") + F.col("_place")).alias("position"),
        "turn",
        F.when(F.col("speaking") == SYSTEM, F.lit(SYSTEM)).when(own, F.lit("assistant")).otherwise(F.lit("user")).alias("role"),
        F.when((F.col("speaking") != SYSTEM) & ~own, F.col("speaking")).alias("name"),
        "rendered",
        start.alias("start_char"),
        stop.alias("end_char"),
        F.when(F.col("_head").isNotNull(), start + F.col("_head")).alias("mask_start"),
        F.when(F.col("_head").isNotNull(), stop - 1).alias("mask_end"),
    )


#: The same rows in SQL (table ``conversations``).
ROTATE_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaking,
         coalesce(replace(replace(text, '<|im_start|>', '<|im_ start|>'), '<|im_end|>', '<|im_ end|>'), '') AS text
  FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id, speaking AS speaker FROM rows WHERE speaking <> 'system'
), views AS (
  SELECT r.conv_id, s.speaker, r.turn, r.speaking, r.text,
         '<|im_start|>' || CASE WHEN r.speaking = 'system' THEN 'system' WHEN r.speaking = s.speaker THEN 'assistant'
           ELSE 'user name=' || r.speaking END || chr(10) AS head
  FROM rows r JOIN speakers s ON r.conv_id IS NOT DISTINCT FROM s.conv_id
), placed AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS rendered,
         row_number() OVER w - 1 AS position,
         CAST(sum(length(head) + length(text) + 11) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_char
  FROM views
  WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, speaking, text)
)
SELECT conv_id, speaker, position, turn,
       CASE WHEN speaking = 'system' THEN 'system' WHEN speaking = speaker THEN 'assistant' ELSE 'user' END AS role,
       CASE WHEN speaking <> 'system' AND speaking <> speaker THEN speaking END AS name,
       rendered, end_char - length(rendered) AS start_char, end_char,
       CASE WHEN speaking = speaker THEN end_char - length(rendered) + length(head) END AS mask_start,
       CASE WHEN speaking = speaker THEN end_char - 1 END AS mask_end
FROM placed
"""
