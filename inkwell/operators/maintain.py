"""Keeping a lexicon in order: pruning, removing, exporting, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as tx


def doomed_grams(grams: DataFrame, vouched: DataFrame | None = None) -> DataFrame:
    """Grams that hold a word no tokenizer would make; with ``vouched``, also those that hold a word nobody vouches for."""
    parts = grams.select("gram").distinct().select("gram", F.explode(F.split("gram", " ")).alias("word"))
    odd = parts.where(~tx.is_lexical(F.col("word")))
    if vouched is not None:
        odd = odd.unionByName(parts.join(vouched.select("word"), "word", "left_anti").select("gram", "word"))
    return odd.select("gram").distinct()


def vouchers(dictionary: DataFrame, lexicon: DataFrame) -> DataFrame:
    return dictionary.select("word").union(lexicon.where("provenance <> 'observed'").select("word")).distinct()


def doomed_words(lexicon: DataFrame) -> DataFrame:
    """Words that were only observed and that no tokenizer would make."""
    return lexicon.where((F.col("provenance") == "observed") & ~tx.is_lexical(F.col("word"))).select("word")


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key), key, "left_anti")


def removed_word(lexicon: DataFrame, registers: DataFrame, word: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without a word; its sources stay."""
    left = lexicon.where(F.col("word") != word)
    return left, registers.join(left.select("word"), "word", "left_semi")


def removed_phrase(grams: DataFrame, phrase: str) -> DataFrame:
    """Gram counts without a phrase, in every register."""
    return grams.where(F.col("gram") != phrase)


def added_words(lexicon: DataFrame, words: DataFrame) -> DataFrame:
    """The lexicon with words that the user vouches for: they are theirs from now on, whatever they were."""
    mine = words.select(tx.normalise(F.trim("word")).alias("word")).where("word <> ''").distinct()
    others = lexicon.select("word", "provenance").join(mine, "word", "left_anti")
    return others.unionByName(mine.withColumn("provenance", F.lit("user")))


def counts_without_names(counts: DataFrame, names: DataFrame) -> DataFrame:
    """Word counts of own vocabulary: names of things one works on say nothing about it."""
    return counts.join(names.select("word").distinct(), "word", "left_anti")


def exportable(entries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Entries with a provenance above observed or two documents, that the dictionary lacks."""
    return entries.where((F.col("provenance") != "observed") | (F.col("sources") >= 2)).join(dictionary.select("word"), "word", "left_anti")


def strongest(entries: DataFrame, dictionary: DataFrame, limit: int = 1000) -> DataFrame:
    """The most valid exportable entries."""
    return exportable(entries, dictionary).orderBy(F.desc("validity"), F.desc("sources"), "word").limit(limit)


def installed(present: DataFrame, manifest: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A shared word file and its manifest after an install: what was there stays, and the manifest remembers all we ever added."""
    fresh = words.select("word").join(present.select("word"), "word", "left_anti")
    return present.select("word").union(fresh).distinct(), manifest.select("word").union(fresh).distinct()


def uninstalled(present: DataFrame, manifest: DataFrame) -> DataFrame:
    """The shared file without exactly the words we added."""
    return present.select("word").join(manifest.select("word"), "word", "left_anti")


def status(lexicon: DataFrame, grams: DataFrame, registers: DataFrame, prose: DataFrame, captured: DataFrame) -> DataFrame:
    """``section, name, value`` rows: totals, words by provenance and register, documents by register, messages by origin."""
    origin = F.when(F.col("source_key").startswith("slack:"), "slack").when(F.col("source_key").startswith("gh:"), "github").otherwise("other")
    row = lambda df, section, name: df.select(F.lit(section).alias("section"), name.alias("name"), F.col("value").cast("long").alias("value"))
    n = F.count(F.lit(1)).alias("value")
    return (
        row(lexicon.agg(n), "total", F.lit("words"))
        .unionByName(row(grams.select("gram").distinct().agg(n), "total", F.lit("ngrams")))
        .unionByName(row(lexicon.groupBy("provenance").agg(n), "by_provenance", F.col("provenance")))
        .unionByName(row(registers.groupBy("register").agg(n), "by_register", F.col("register")))
        .unionByName(row(prose.where("metric = 'documents'"), "documents", F.col("register")))
        .unionByName(row(captured.groupBy(origin.alias("origin")).agg(n), "messages", F.col("origin")))
    )
