"""From texts to lines, words and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.functions.lets import explode, let, posexplode
from inkwell.functions.mask import mask


def text_lines(text: Column) -> Column:
    """Lines of a text without line ends; a last empty line doesn't count."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    return let(lines, lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a))


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row for each line, ``line`` from 1 and ``raw``; the other columns stay."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, posexplode(text_lines(F.col(text))).alias("at", "raw")).where("raw is not null").select(*rest, (F.col("at") + 1).alias("line"), "raw")


def prose_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Lines that read as prose, with ``folded`` typography and ``masked`` regions."""
    kept = lines(df, text).where(tx.is_prose(F.col("raw")))
    return kept.withColumn("folded", tx.fold_typography(F.col("raw"))).withColumn("masked", mask(F.col("folded")))


def prose_words(df: DataFrame, text: str = "text") -> DataFrame:
    """Prose lines with ``words``: normalised tokens of two characters or more, in order."""
    made = F.filter(F.transform(tx.tokens(F.col("masked")), tx.normalise), lambda w: F.length(w) >= 2)
    return prose_lines(df, text).withColumn("words", made)


def words(df: DataFrame, text: str = "text") -> DataFrame:
    """One row for each lexical word of the prose."""
    rest = [c for c in df.columns if c != text]
    return words_of(prose_words(df, text).select(*rest, "line", "words"))


def words_of(lines: DataFrame) -> DataFrame:
    """The same from lines with ``words``."""
    rest = [c for c in lines.columns if c != "words"]
    return lines.select(*rest, explode("words").alias("word")).where(tx.is_lexical(F.col("word")))


def runs(df: DataFrame, text: str = "text") -> DataFrame:
    """One row for each maximal stretch of lexical words: ``line``, ``run`` and ``words``."""
    rest = [c for c in df.columns if c != text]
    return runs_of(prose_words(df, text).select(*rest, "line", "words"))


def runs_of(lines: DataFrame) -> DataFrame:
    """The same from lines with ``words``."""
    rest = [c for c in lines.columns if c != "words"]
    return lines.select(*rest, posexplode(tx.lexical_runs(F.col("words"))).alias("run", "words")).where("words is not null")


def sentence_shapes(df: DataFrame, text: str = "text", masked: bool = True) -> DataFrame:
    """Length in words and syllables of each sentence with a letter in it.

    Sentences span the whole text; ``masked``: regions that aren't prose don't count, as in the learned statistics.
    """
    rest = [c for c in df.columns if c != text]
    folded = df.select(*rest, explode(tx.sentences(F.coalesce(F.col(text), F.lit("")))).alias("s")).where("s is not null").withColumn("s", tx.fold_typography(F.col("s")))
    body = mask(F.col("s")) if masked else F.col("s")
    shaped = folded.withColumn("w", F.filter(F.transform(tx.tokens(body), tx.normalise), lambda w: w.rlike(r"\p{IsAlphabetic}"))).where(F.size("w") > 0)
    return shaped.select(*rest, F.size("w").alias("length"), F.aggregate("w", F.lit(0), lambda a, w: a + tx.syllables(w)).alias("syllables"))
