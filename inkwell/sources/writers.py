"""Sinks: findings as JSON, word lists for editors, tables that are replaced whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def findings_ndjson(findings: DataFrame, path: str) -> None:
    """One JSON object for each finding."""
    findings.write.mode("overwrite").json(path)


def findings_json(findings: DataFrame, path: str) -> None:
    """One JSON array of all findings in reading order, in one file: a report, which one task writes by purpose."""
    key = findings.columns[0]
    one = findings.orderBy(key, "line", "col").coalesce(1).select(F.to_json(F.struct("*")).alias("j")).agg(F.collect_list("j").alias("js"))
    one.select(F.concat(F.lit("["), F.array_join("js", ","), F.lit("]")).alias("value")).write.mode("overwrite").text(path)


def findings_text(findings: DataFrame, path: str) -> None:
    """A line for each finding: place, kind, word and what is suggested."""
    key = findings.columns[0]
    place = F.concat_ws(":", F.col(key).cast("string"), F.col("line").cast("string"), F.col("col").cast("string"))
    more = F.when(F.size("suggestions") > 0, F.concat(F.lit(" -> "), F.array_join(F.transform("suggestions", lambda s: s["word"]), ", "))).otherwise("")
    findings.select(F.concat(place, F.lit(" "), F.col("kind"), F.lit(" "), F.col("word"), more).alias("value")).write.mode("overwrite").text(path)


def settled(df: DataFrame) -> DataFrame:
    """A frame that no longer reads the files it came from, so that they can be replaced."""
    from inkwell.sources.scratch import kept

    return kept(df, "settled")


def word_list(words: DataFrame, path: str) -> None:
    """A plain word list in one file, sorted. An export is what editors load, so one task holds it by purpose."""
    words.select("word").distinct().orderBy("word").coalesce(1).write.mode("overwrite").text(path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")


def replace_table(df: DataFrame, path: str) -> None:
    """Write a table anew; the frame must not read from the same path."""
    df.write.mode("overwrite").parquet(path)
