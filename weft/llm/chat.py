"""Chat formatting by perspective rotation.

For every participant of a dialogue, the dialogue is rendered with this speaker as the assistant and all others as named users;
only the assistant's own messages are trained on. A rendering is a sequence of segments with their places in the whole text, so a
dialogue of any length is never gathered into one row or task: places come from running sums within chunks of turns, and from
sums of the chunks before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a chunk in values of the turn column.
CHUNK = 256
# The role that speaks in every rendering as itself, and the name of a speaker without one.
SYSTEM, NAMELESS = "system", "unknown"
#: What could be read as a mark, in a name or text: it gets one backslash more, so marks can't be forged and taking one off undoes it.
MARK = r"<(\\*)\|"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, MARK, r"<\\$1|")


def rotate(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row for each segment of each rendering: ``conv_id, perspective, position, role, name, segment, start, end,
    loss_start, loss_end``. Segments of one rendering by ``position`` make up its text; ``start`` and ``end`` are code points
    in it. ``loss_start`` to ``loss_end`` is what is trained on: the assistant's text with its end mark; null elsewhere.

    Messages are ordered by turn (null last), then role and text, so ties and repeated rows have a defined place; repeated
    rows are messages of their own. A null role is the speaker ``unknown``; a null text is empty; a null conversation
    id is one conversation. A ``<|`` in a text or name is escaped by a backslash between (``name`` itself stays as it is). ``system`` messages belong to every rendering but aren't a participant: a dialogue of nothing else has
    no rendering. Other columns are ignored. The result has as many rows as messages times participants, by its meaning.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(NAMELESS)).alias("speaker"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    speakers = rows.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    own = rows.join(speakers, rows["conv_id"].eqNullSafe(speakers["_conv"])).drop("_conv")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    name = F.when(role == "user", F.col("speaker"))
    head = F.when(role == "user", F.concat(F.lit("<|user|>"), escaped(name), F.lit("\n"))).otherwise(F.concat(F.lit("<|"), role, F.lit("|>\n")))
    own = own.select("conv_id", "perspective", "turn", "speaker", "text", role.alias("role"), name.alias("name"), head.alias("head"))
    own = own.withColumn("segment", F.concat(F.col("head"), escaped(F.col("text")), F.lit("<|end|>\n"))).withColumn("chunk", F.floor(F.col("turn") / chunk))
    key = ["conv_id", "perspective", "chunk"]
    own = own.repartition(*key)
    sums = own.groupBy(*key).agg(F.sum(F.length("segment").cast("long")).alias("chars"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id", "perspective").orderBy(F.asc_nulls_last("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *[F.col(k).alias(f"_{k}") for k in key],
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("_chars"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"),
    )
    within = Window.partitionBy(*key).orderBy(F.asc_nulls_last("turn"), "speaker", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = own.withColumn("_end", F.sum(F.length("segment").cast("long")).over(within)).withColumn("_i", F.count("*").over(within))
    out = placed.join(sums, placed["conv_id"].eqNullSafe(sums["_conv_id"]) & (placed["perspective"] == sums["_perspective"]) & placed["chunk"].eqNullSafe(sums["_chunk"]))
    end = F.col("_chars") + F.col("_end")
    start = end - F.length("segment")
    trained = F.col("role") == "assistant"
    return out.select(
        "conv_id",
        "perspective",
        (F.col("_n") + F.col("_i") - 1).cast("long").alias("position"),
        "role",
        "name",
        "segment",
        start.cast("long").alias("start"),
        end.cast("long").alias("end"),
        F.when(trained, start + F.length("head")).cast("long").alias("loss_start"),
        F.when(trained, end).cast("long").alias("loss_end"),
    )
