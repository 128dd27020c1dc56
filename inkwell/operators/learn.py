"""Folding staged texts into what is kept: words, registers, sources, sentence shape, exemplars. Texts themselves are not kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import authorship
from inkwell.functions import text as tx
from inkwell.operators import complexity, phrases, tokens

EXEMPLARS, EXEMPLAR_WORDS = 25, 6


def prepared(rows: DataFrame) -> DataFrame:
    """``doc, register, body, authored_by`` with the user's trailers cut."""
    body = F.when(F.col("authored_by") == "user", authorship.strip_trailer(F.col("body"))).otherwise(F.col("body"))
    return rows.select("doc", "register", "authored_by", body.alias("text"))


def learned_words(rows: DataFrame) -> DataFrame:
    """``word, count, sources``: the user's words count, anybody's word is known and has its sources."""
    words = tokens.words(prepared(rows))
    by_doc = words.groupBy("word", "doc").agg(F.count_if(F.col("authored_by") == "user").alias("c"))
    return by_doc.groupBy("word").agg(F.sum("c").cast("long").alias("count"), F.count(F.lit(1)).alias("sources"))


def learned(rows: DataFrame, order: list[str]) -> dict[str, DataFrame]:
    """All tables of one drain: ``words``, ``registers``, ``sources``, ``grams``, ``prose``, ``sentences``, ``exemplars``.

    ``rows``: ``doc, register, body, authored_by`` and the ``order`` columns, oldest first.
    """
    kept = prepared(rows)
    mine = kept.where("authored_by = 'user'")
    words = tokens.words(kept)
    staged = rows.where("authored_by = 'user'").select(*order, "register", authorship.strip_trailer(F.col("body")).alias("text"))
    documents = rows.groupBy("register").agg(F.count(F.lit(1)).alias("value")).select("register", F.lit("documents").alias("metric"), "value")
    return {
        "words": learned_words(rows),
        "registers": words.where("authored_by = 'user'").groupBy("word", "register").agg(F.count(F.lit(1)).alias("count")),
        "sources": words.select("word", "doc").distinct(),
        "grams": phrases.gated_counts(tokens.runs(staged), [*order, "line", "run"], "register"),
        "prose": documents.unionByName(complexity.prose_stats(mine, "register").where("metric <> 'documents'")),
        "sentences": complexity.sentence_histogram(mine, "register"),
        "exemplars": exemplars(staged, "register", [*order, "line"]),
    }


def exemplars(df: DataFrame, register: str, order: list[str], most: int = EXEMPLARS) -> DataFrame:
    """The longest lines of each register by words; later ones first among equals."""
    rows = tokens.prose_words(df).where(F.size("words") >= EXEMPLAR_WORDS)
    shown = rows.select(register, *order, F.size("words").alias("score"), F.trim(tx.fold_typography(F.col("raw"))).alias("text"))
    best = Window.partitionBy(register).orderBy(F.desc("score"), *[F.desc(c) for c in order])
    return shown.withColumn("i", F.row_number().over(best)).where(F.col("i") <= most).drop("i")
