"""Captured prose that waits to be learned from: a table with an id in order of arrival, emptied in batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators import hooks

SPOOL = "id long, register string, source string, body string, authored_by string, author string"
#: Rows that a command and the end of a turn process.
COMMAND_ROWS, TURN_ROWS = 500, 200


def spooled(spool: DataFrame, rows: DataFrame, after: int, order: list[Column]) -> DataFrame:
    """The spool with ``rows`` (register, source, body, authored_by, author where known) behind it; ids go on from ``after`` in the given order, within one batch."""
    # one batch of arrivals is numbered: what an editor's session or a read of a channel brings
    ids = F.row_number().over(Window.orderBy(*order)) + F.lit(after)
    author = F.col("author") if "author" in rows.columns else F.lit(None).cast("string")
    new = rows.select(ids.cast("long").alias("id"), "register", "source", "body", "authored_by", author.alias("author"))
    return spool.unionByName(new)


def pending(spool: DataFrame, limit: int = COMMAND_ROWS) -> DataFrame:
    """The oldest rows, with ``doc``: where they came from and their id. A bounded batch by purpose."""
    rows = spool.orderBy("id").limit(limit)
    doc = F.concat(F.coalesce("source", F.lit("capture")), F.lit("#"), F.col("id").cast("string"))
    return rows.select("id", "register", "body", "authored_by", doc.alias("doc"))


def retired(spool: DataFrame, done: DataFrame) -> DataFrame:
    """The spool without the rows that were processed."""
    return spool.join(done.select("id"), "id", "left_anti")


def drain(spool: DataFrame, limit: int = COMMAND_ROWS) -> tuple[DataFrame, DataFrame]:
    """One batch of pending rows and the spool that is left."""
    batch = pending(spool, limit)
    return batch, retired(spool, batch)


def claimed_into(spool: DataFrame, messages: DataFrame, identities: DataFrame, captured: DataFrame, after: int) -> tuple[DataFrame, DataFrame]:
    """The spool and the captured keys after a read of a channel: only own messages that weren't captured, each once, go in, and both change together."""
    own = hooks.own_messages(messages, identities, captured)
    rows = own.select("register", F.col("source_key").alias("source"), "body", F.lit("user").alias("authored_by"), "author")
    keys = captured.select("source_key").unionByName(own.select("source_key"))
    return spooled(spool, rows, after, [F.col("source")]), keys


def dispatched(payloads: DataFrame, spool: DataFrame, after: int) -> tuple[DataFrame, DataFrame | None]:
    """What a batch of hook payloads does: prompts and sent texts are spooled, and if a turn ended a batch is drained. Anything else, and bad payloads, do nothing."""
    staged = hooks.staged(payloads).withColumn("authored_by", F.lit("user"))
    grown = spooled(spool, staged, after, [F.col("register"), F.col("source"), F.col("body")])
    ended = not hooks.event_of(payloads).where("event = 'stop'").isEmpty()
    if not ended:
        return grown, None
    batch, left = drain(grown, TURN_ROWS)
    return left, batch
