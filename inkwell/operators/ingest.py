"""From records to staged texts: attribution, de-duplication, message harvest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import authorship
from inkwell.functions.text import appears_bounded

RECORD = "body string, author string, register string, source string"
REGISTERS = ("commit", "pr", "slack", "email", "doc", "prompt", "note", "other")


def records(raw: DataFrame, column: str = "value") -> DataFrame:
    """Records from JSON texts, each one object, an array of objects, or one object a line. Texts that don't parse give nothing."""
    whole = F.trim(F.col(column))
    objects = F.when(whole.startswith("["), F.from_json(whole, f"array<struct<{RECORD.replace(' string', ':string')}>>")).otherwise(
        F.transform(F.filter(F.split(whole, "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, RECORD))
    )
    return raw.select(F.explode(objects).alias("r")).select("r.*").where("body is not null")


def attributed(rows: DataFrame, selves: list[str], register: str = "other") -> DataFrame:
    """Rows with a body, with ``authored_by`` (an assistant's marker wins; no author or one of ``selves`` is the user) and a register."""
    mine = F.col("author").isNull() | F.lower("author").isin([s.lower() for s in selves])
    who = F.when(authorship.is_assistant(F.col("body")), "assistant").when(mine, "user").otherwise("other")
    named = F.coalesce(F.when(F.lower("register").isin(*REGISTERS), F.lower("register")), F.lit(register)) if "register" in rows.columns else F.lit(register)
    return rows.where(F.trim("body") != "").withColumn("authored_by", who).withColumn("register", named)


def report(attributed_rows: DataFrame, all_rows: int) -> DataFrame:
    """What an ingest did: staged, by whom, and how many bodies were empty."""
    n = lambda who: F.count_if(F.col("authored_by") == who)
    return attributed_rows.agg(F.count(F.lit(1)).alias("ingested"), n("user").alias("by_user"), n("other").alias("by_others"), n("assistant").alias("by_assistant")).withColumn("empty", F.lit(all_rows) - F.col("ingested"))


def claimed(rows: DataFrame, order: str, key: str = "source_key", captured: DataFrame | None = None) -> DataFrame:
    """The first row of each key, without keys that were captured before."""
    left = rows if captured is None else rows.join(captured.select(key), key, "left_anti")
    rest = [c for c in rows.columns if c not in (key, order)]
    first = left.groupBy(key).agg(F.min_by(F.struct(order, *rest), order).alias("x"))
    return first.select(key, "x.*")


def harvested(messages: DataFrame, identities: DataFrame) -> DataFrame:
    """Messages whose author is a known handle that isn't denied."""
    known = identities.where(~F.col("denied")).select(F.lower("handle").alias("h")).distinct()
    return messages.join(known, F.lower("author") == F.col("h"), "left_semi")


def outbound(tool: Column, payload: Column) -> Column:
    """Register and text of what a tool call sends: ``register, body``, else null."""
    mail = tool.rlike("(?i)gmail.*(create_draft|send_message|reply|forward)")
    slack = tool.rlike("(?i)slack.*send_message")
    text = F.when(mail, F.get_json_object(payload, "$.body")).when(slack, F.get_json_object(payload, "$.text"))
    return F.when(text.isNotNull() & (F.trim(text) != ""), F.struct(F.when(mail, "email").otherwise("slack").alias("register"), text.alias("body")))


def learned_identities(lines: DataFrame, identities: DataFrame, column: str = "line") -> DataFrame:
    """Handles ``(ID: x)`` on lines that name a known handle; new ones only. ``identities`` are a person's own few handles and are broadcast when Spark finds them small."""
    known = identities.where(~F.col("denied")).select(F.lower("handle").alias("known")).distinct()
    rows = lines.select(F.lower(column).alias("l")).where(F.col("l").contains("(id:"))
    named = rows.join(known, appears_bounded(F.col("l"), F.col("known")), "left_semi")
    found = named.select(F.trim(F.regexp_extract("l", r"\(id:([^)]*)", 1)).alias("handle")).where((F.col("handle") != "") & (F.length("handle") <= 32))
    return found.distinct().join(known.select(F.col("known").alias("handle")), "handle", "left_anti").select("handle", F.lit("observed").alias("source"))


def identity_state(actions: DataFrame) -> DataFrame:
    """``handle, source, denied`` from ``handle, source, action, seq``: the last manual action decides, detection never overrules a denial."""
    rows = actions.withColumn("handle", F.lower("handle")).where((F.col("handle") != "") & (F.length("handle") <= 128))
    manual = F.col("source") == "manual"
    last = rows.groupBy("handle").agg(F.max_by("action", F.when(manual, F.col("seq"))).alias("said"), F.min_by("source", "seq").alias("first"), F.count_if(manual & (F.col("action") == "add")).alias("added"))
    return last.select("handle", F.when(F.col("added") > 0, "manual").otherwise(F.col("first")).alias("source"), (F.coalesce("said", F.lit("add")) == "remove").alias("denied"))
