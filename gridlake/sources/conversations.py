"""Conversations as JSON documents and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions.text import DEFAULT_SYSTEM
from gridlake.plans.ordered import with_position

DOCUMENT = (
    "system_prompt string, part bigint, conversation array<struct<role string, content string, timestamp string>>"
)
PART_MESSAGES = 10_000


def export_conversations(
    messages: DataFrame, system: str = DEFAULT_SYSTEM, part_messages: int = PART_MESSAGES
) -> DataFrame:
    """``conv_id, part, document``: JSON of at most ``part_messages`` consecutive messages each."""
    numbered = with_position(messages, ["conv_id"], ["turn"], "_at")
    stamp = F.col("timestamp") if "timestamp" in messages.columns else F.lit(None).cast("string")
    parts = (
        numbered.withColumn("part", F.floor(F.col("_at") / part_messages))
        .groupBy("conv_id", "part")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("_at", F.struct("role", F.col("text").alias("content"), stamp.alias("timestamp")).alias("m"))
                )
            ).alias("_s")
        )
    )
    body = F.struct(
        F.lit(system).alias("system_prompt"), "part", F.transform("_s", lambda s: s["m"]).alias("conversation")
    )
    return parts.select("conv_id", "part", F.to_json(body).alias("document"))


def import_conversations(documents: DataFrame, part_messages: int = PART_MESSAGES) -> DataFrame:
    """``conv_id, turn, role, text, timestamp`` from exported documents; turns are dense."""
    parsed = documents.select("conv_id", F.from_json("document", DOCUMENT).alias("d"))
    rows = parsed.select(
        "conv_id", F.coalesce("d.part", F.lit(0)).alias("part"), F.posexplode("d.conversation").alias("i", "m")
    )
    return rows.select(
        "conv_id",
        (F.col("part") * part_messages + F.col("i")).alias("turn"),
        "m.role",
        F.col("m.content").alias("text"),
        "m.timestamp",
    )
