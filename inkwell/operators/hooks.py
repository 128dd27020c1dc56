"""Payloads of an editor's or assistant's events, routed to what they teach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import authorship
from inkwell.functions import text as tx
from inkwell.operators import ingest

#: Days after which a seed is taken anew.
SEED_DAYS = 30


def event_of(payloads: DataFrame) -> DataFrame:
    """Payloads with ``event``: ``prompt``, ``tool``, ``stop``, or null for those that change nothing."""
    name = F.lower(F.regexp_replace("hook_event_name", "[^A-Za-z]", ""))
    return payloads.withColumn("event", F.when(name == "userpromptsubmit", "prompt").when(name == "posttooluse", "tool").when(name == "stop", "stop"))


def staged(payloads: DataFrame) -> DataFrame:
    """``register, source, body``: prompts that were typed and texts that tools sent. Bad or empty payloads give nothing."""
    rows = event_of(payloads)
    prompts = rows.where("event = 'prompt'").select(F.lit("prompt").alias("register"), F.col("session_id").alias("source"), authorship.typed_prompt(F.coalesce("prompt", F.lit(""))).alias("body"))
    sent = rows.where("event = 'tool'").select(F.col("session_id").alias("source"), ingest.outbound(F.coalesce("tool_name", F.lit("")), F.col("tool_input")).alias("x"))
    return prompts.unionByName(sent.select("x.register", "source", "x.body")).where("body is not null")


def responses(payloads: DataFrame) -> DataFrame:
    """Tool responses that can hold messages, by kind: ``slack`` or ``github``."""
    tool = F.lower(F.coalesce("tool_name", F.lit("")))
    kind = F.when(tool.contains("slack"), "slack").when(tool.contains("github") | (tool == "bash"), "github")
    return event_of(payloads).where("event = 'tool'").select(kind.alias("kind"), "tool_response").where("kind is not null and tool_response is not null")


def own_messages(messages: DataFrame, identities: DataFrame, captured: DataFrame) -> DataFrame:
    """Messages of known handles that were not captured before, each once. Without identities nothing is anybody's."""
    mine = ingest.harvested(messages, identities)
    return mine.join(captured.select("source_key"), "source_key", "left_anti").dropDuplicates(["source_key"])


def people(messages: DataFrame, seen: Column | None = None) -> DataFrame:
    """``name, display, count, days`` of everybody who wrote: the checker's names."""
    rows = messages.select(F.trim("display").alias("display"), "source_key", (seen if seen is not None else F.current_timestamp()).alias("seen")).where("display <> ''")
    named = rows.withColumn("name", tx.normalise(F.col("display")))
    return named.groupBy("name").agg(F.min("display").alias("display"), F.count(F.lit(1)).alias("count"), F.count_distinct(F.to_date("seen")).alias("days"))


def seed_due(seeded_at: Column, now: Column) -> Column:
    """Whether a store was never seeded, or too long ago."""
    return seeded_at.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(seeded_at) > SEED_DAYS * 86_400)
