"""Lexical diversity and readability, of one text each or of a whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.operators import tokens

LONG_WORD, LONGEST_SENTENCE = 7, 60


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a.cast("double") / b.cast("double"))


def from_counts(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Vocabulary measures of ``word, count`` rows, for each group of ``by``; zeros without words."""
    c, size = F.col("count"), F.length("word")
    sums = [
        F.coalesce(F.sum(c), F.lit(0)).cast("long").alias("tokens"),
        F.count("word").alias("types"),
        F.coalesce(F.sum(F.when(c == 1, 1)), F.lit(0)).cast("long").alias("hapax"),
        F.coalesce(F.sum(size * c), F.lit(0)).cast("long").alias("chars"),
        F.coalesce(F.sum(F.when(size >= LONG_WORD, c)), F.lit(0)).cast("long").alias("long"),
    ]
    rows = counts.groupBy(*by).agg(*sums) if by else counts.agg(*sums)
    t, v = F.col("tokens"), F.col("types")
    return rows.select(
        *(by or []),
        "tokens",
        "types",
        ratio(v, t).alias("type_token_ratio"),
        F.when(t == 0, 0.0).otherwise(v / F.sqrt(t.cast("double"))).alias("guiraud_r"),
        ratio(F.col("hapax"), v).alias("hapax_ratio"),
        ratio(F.col("chars"), t).alias("mean_word_length"),
        ratio(F.col("long"), t).alias("long_word_ratio"),
    )


def flesch(sentences: Column, words: Column, syllables: Column) -> Column:
    return F.lit(206.835) - F.lit(1.015) * ratio(words, sentences) - F.lit(84.6) * ratio(syllables, words)


def spread(histogram: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Population standard deviation of ``length`` over ``count`` rows; 0 for fewer than two sentences."""
    n, x = F.col("count").cast("double"), F.col("length").cast("double")
    sums = [F.sum(n).alias("n"), F.sum(n * x).alias("s"), F.sum(n * x * x).alias("q")]
    rows = histogram.groupBy(*by).agg(*sums) if by else histogram.agg(*sums)
    mean = F.col("s") / F.col("n")
    return rows.select(*(by or []), F.when(F.col("n") < 2, 0.0).otherwise(F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))).alias("sentence_length_stddev"))


def by_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Vocabulary and readability of each text with prose in it."""
    source = df.select(key, F.col(text).alias("text"))
    counts = tokens.words(source).groupBy(key, "word").agg(F.count(F.lit(1)).alias("count"))
    vocabulary = from_counts(counts, [key])
    pronounced = counts.groupBy(key).agg(F.sum(tx.syllables(F.col("word")) * F.col("count")).alias("syllables"))
    shapes = tokens.sentence_shapes(source, masked=False).groupBy(key).agg(F.count(F.lit(1)).alias("sentences"), F.coalesce(F.stddev_pop("length"), F.lit(0.0)).alias("sentence_length_stddev"))
    rows = vocabulary.join(pronounced, key).join(shapes, key, "left")
    s, t, y = F.coalesce("sentences", F.lit(0)), F.col("tokens"), F.col("syllables")
    return rows.select(*vocabulary.columns, s.alias("sentences"), ratio(t, s).alias("mean_sentence_length"), F.coalesce("sentence_length_stddev", F.lit(0.0)).alias("sentence_length_stddev"), ratio(y, t).alias("mean_syllables_per_word"), flesch(s, t, y).alias("flesch_reading_ease"))


def sentence_histogram(df: DataFrame, register: str, text: str = "text") -> DataFrame:
    """Sentences of each register by length in words; lengths beyond the last bar share it."""
    return tokens.sentence_shapes(df.select(register, F.col(text).alias("text"))).groupBy(register, F.least("length", F.lit(LONGEST_SENTENCE)).alias("length")).agg(F.count(F.lit(1)).alias("count"))


def prose_stats(df: DataFrame, register: str, text: str = "text") -> DataFrame:
    """``register, metric, value`` for documents, sentences, words and syllables; zeros have no row."""
    shapes = tokens.sentence_shapes(df.select(register, F.col(text).alias("text"))).groupBy(register).agg(F.count(F.lit(1)).alias("sentences"), F.sum("length").alias("words"), F.sum("syllables").alias("syllables"))
    wide = df.groupBy(register).agg(F.count(F.lit(1)).alias("documents")).join(shapes, register, "left")
    metrics = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("value")) for m in ("documents", "sentences", "words", "syllables")])
    return wide.select(register, F.explode(metrics).alias("x")).select(register, "x.metric", "x.value").where("value > 0")
