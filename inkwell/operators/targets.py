"""Dictionaries of other programs that a lexicon is written to, and what of it is there."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import maintain
from inkwell.sources import writers


@dataclass(frozen=True)
class Target:
    """A word list: ``owned`` ones are ours alone, others are shared with the user; ``limit``: words it takes."""

    name: str
    file: str
    owned: bool
    limit: int | None


# The targets' names, files and limits.
TARGETS = (Target("vscode", "vocabulist.txt", True, None), Target("wisprflow", "wisprflow.csv", True, 1000), Target("macos", "LocalDictionary", False, None))


def find(name: str) -> Target | None:
    return next((t for t in TARGETS if t.name == name), None)


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _words(spark: SparkSession, path: str) -> DataFrame:
    return writers.read_words(spark, path) if _there(spark, path) else spark.createDataFrame([], "word string")


def sync(entries: DataFrame, dictionary: DataFrame, folder: str, target: Target) -> None:
    """Write the exportable words (the strongest, where the target takes so many only) and the manifest of what we wrote.

    A shared file keeps the user's words; its new state is read out before the file is replaced.
    """
    spark, path, manifest = entries.sparkSession, f"{folder}/{target.file}", f"{folder}/synced/{target.name}.txt"
    words = maintain.exportable(entries, dictionary).select("word") if target.limit is None else maintain.strongest(entries, dictionary, target.limit).select("word")
    if target.owned:
        writers.word_list(words, path)
        writers.word_list(words, manifest)
        return
    shared, ours = maintain.installed(_words(spark, path), _words(spark, manifest), words)
    shared, ours = writers.settled(shared), writers.settled(ours)
    writers.word_list(shared, path)
    writers.word_list(ours, manifest)


def unsync(spark: SparkSession, folder: str, target: Target) -> None:
    """Take exactly what we added out of a target; an owned file ends empty."""
    path, manifest = f"{folder}/{target.file}", f"{folder}/synced/{target.name}.txt"
    left = writers.settled(maintain.uninstalled(_words(spark, path), _words(spark, manifest)))
    writers.word_list(left.limit(0) if target.owned else left, path)
    writers.word_list(left.limit(0), manifest)


def statuses(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """``name, present, ours, total`` of every target from the lines of its file and manifest (``name, word``; a present but empty file has a null word)."""
    spark = files.sparkSession
    names = spark.createDataFrame([(t.name,) for t in TARGETS], "name string")
    lines = lambda df: df.groupBy("name").agg(F.count(F.when(F.trim("word") != "", 1)).alias("n"))
    total, ours = lines(files).withColumnRenamed("n", "total"), lines(manifests).withColumnRenamed("n", "ours")
    rows = names.join(total, "name", "left").join(ours, "name", "left")
    return rows.select("name", F.col("total").isNotNull().alias("present"), F.coalesce("ours", F.lit(0)).cast("long").alias("ours"), F.coalesce("total", F.lit(0)).cast("long").alias("total"))


def status(spark: SparkSession, folder: str) -> DataFrame:
    """The same read from a folder; a missing file is a normal state."""
    rows = [(t.name, f"{folder}/{t.file}", f"{folder}/synced/{t.name}.txt") for t in TARGETS]
    none = spark.createDataFrame([], "name string, word string")
    files = manifests = none
    for name, path, manifest in rows:
        if _there(spark, path):
            mark = spark.createDataFrame([(name, None)], "name string, word string")
            files = files.unionByName(mark).unionByName(_words(spark, path).select(F.lit(name).alias("name"), "word"))
        manifests = manifests.unionByName(_words(spark, manifest).select(F.lit(name).alias("name"), "word"))
    return statuses(files, manifests)
