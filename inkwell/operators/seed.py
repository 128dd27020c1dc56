"""Seeding a lexicon from ground truth: terms of repositories, tools, dependencies; mined frequencies; core words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.functions.lets import explode
from inkwell.operators import tokens, vocabulary

CORE_SCALE = 1_000_000


def expanded(terms: DataFrame) -> DataFrame:
    """``word, display, provenance, source`` from ``term, provenance, source``: the whole term and its parts."""
    rows = terms.select("provenance", "source", explode(tx.expand_term(F.col("term"))).alias("word")).where("word is not null")
    return rows.select("word", F.col("word").alias("display"), "provenance", "source")


def merged(terms: DataFrame) -> DataFrame:
    """One row for each word, with its strongest provenance and the display that came with it; seeds count nothing."""
    rank = vocabulary.rank_of(F.col("provenance"))
    rows = expanded(terms).withColumn("prov_rank", rank)
    best = rows.groupBy("word").agg(F.max("prov_rank").alias("prov_rank"), F.max_by("display", "prov_rank").alias("display"))
    return best.select("word", "display", vocabulary.name_of(F.col("prov_rank")).alias("provenance"), "prov_rank", F.lit(0).cast("long").alias("count"))


def source_report(terms: DataFrame) -> DataFrame:
    """Distinct terms that each source gave."""
    return expanded(terms).groupBy("source", "provenance").agg(F.count_distinct("word").alias("terms"))


def mined_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``word, count`` of prose words made of letters and apostrophes: no hyphens, two characters or more."""
    words = tokens.prose_words(df.select(F.col(text).alias("text"))).select(explode("words").alias("word"))
    return minable(words).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def minable(words: DataFrame) -> DataFrame:
    return words.where(F.col("word").rlike("^[A-Za-z']*[A-Za-z][A-Za-z']*$"))


def core_counts(ranked: DataFrame) -> DataFrame:
    """``word, count`` by Zipf's rule from ``word, rank`` (from 0); a repeated word keeps its earlier rank."""
    return ranked.groupBy("word").agg(F.min("rank").alias("rank")).select("word", F.floor(F.lit(CORE_SCALE) / (F.col("rank") + 1)).cast("long").alias("count"))


def frequencies(core: DataFrame, mined: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``word, source, count``: the core's greatest count stands, mined counts are replaced whole."""
    kept = core.select("word", "count") if before is None else core.select("word", "count").unionByName(before.where("source = 'core'").select("word", "count"))
    return kept.groupBy("word").agg(F.max("count").alias("count")).select("word", F.lit("core").alias("source"), "count").unionByName(mined.select("word", F.lit("mined").alias("source"), "count"))


def totals(table: DataFrame) -> DataFrame:
    return table.groupBy("word").agg(F.sum("count").alias("count"))
