"""Streams: checking texts as they arrive, claiming messages once, draining staged texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkwell.operators.findings import findings
from inkwell.operators.known import Dims


def claimed_once(messages: DataFrame, key: str = "source_key", time: str | None = None, late: str = "30 days") -> DataFrame:
    """Each message once, by its key; with an event time the memory of keys is bounded by a watermark."""
    if time is None:
        return messages.dropDuplicates([key])
    return messages.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def each_batch(stream: DataFrame, drain: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``drain`` on what has arrived, then stop. ``drain`` gets the batch's number, so writing under it makes a repeat harmless."""
    return stream.writeStream.foreachBatch(drain).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def check_arrivals(texts: DataFrame, dims: Dims, out: str, checkpoint: str, key: str = "path") -> StreamingQuery:
    """Findings of new texts, one folder for each batch."""

    def drain(batch: DataFrame, number: int) -> None:
        findings(batch, dims, key=key).write.mode("overwrite").json(f"{out}/batch={number}")

    return each_batch(texts, drain, checkpoint)


LINE_STATE = "doc_id string, line int, raw string, state string"


def line_states(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines of documents (``doc_id, seq, raw``) that arrive bit by bit, each with its state: checked, names only, or silent.

    What is remembered of a document is its line number and the fence or front matter it is in.
    """

    def step(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        line, fence, front = state.get if state.exists else (0, "", False)
        rows = []
        for frame in frames:
            for raw in frame.sort_values("seq")["raw"]:
                line += 1
                t = raw.strip()
                if line == 1 and t == "---":
                    front, now = True, "s"
                elif front:
                    front, now = t not in ("---", "..."), "s"
                elif fence:
                    fence, now = ("" if t.startswith(fence) else fence), "c"
                elif t.startswith(("```", "~~~")):
                    fence, now = t[:3], "f"
                else:
                    now = "p"
                rows.append((str(own[0]), line, raw, now))
        state.update((line, fence, front))
        yield pd.DataFrame(rows, columns=["doc_id", "line", "raw", "state"])

    grouped = lines.select(F.col(key).cast("string").alias("doc_id"), "seq", "raw").groupBy("doc_id")
    return grouped.applyInPandasWithState(step, LINE_STATE, "line int, fence string, front boolean", "append", GroupStateTimeout.NoTimeout)
