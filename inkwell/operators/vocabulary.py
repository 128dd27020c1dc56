"""The lexicon: words with counts, registers, sources, provenance and validity."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.dims import PROVENANCE, RANK


#: Documents from which a corpus word gets a level; below the last it is 60.
LEVELS = ((200, 10), (60, 20), (20, 35), (10, 40), (6, 50), (4, 55))


def rank_of(provenance: Column) -> Column:
    """Place of a provenance in rising order; unknown names count as observed."""
    return F.coalesce(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in RANK.items()))[provenance], F.lit(0))


def name_of(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n, _ in PROVENANCE]), rank + 1)


def upsert(rows: DataFrame) -> DataFrame:
    """Fold ``word, display, provenance, increment, seq`` into one row for each word.

    Provenance only rises, counts add up, the first display stays.
    """
    return (
        rows.groupBy("word")
        .agg(F.min_by("display", "seq").alias("display"), F.max(rank_of(F.col("provenance"))).alias("prov_rank"), F.sum("increment").cast("long").alias("count"))
        .select("word", "display", name_of(F.col("prov_rank")).alias("provenance"), "prov_rank", "count")
    )


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """A lexicon with another folded in, and what that did: ``is_new`` and ``upgraded``."""
    both = old.select(F.lit(0).alias("age"), "word", "display", "prov_rank", "count").unionByName(new.select(F.lit(1).alias("age"), "word", "display", "prov_rank", "count"))
    return (
        both.groupBy("word")
        .agg(F.min_by("display", "age").alias("display"), F.max("prov_rank").alias("prov_rank"), F.sum("count").alias("count"), F.min("age").alias("first"), F.max(F.when(F.col("age") == 0, F.col("prov_rank"))).alias("was"))
        .select("word", "display", name_of(F.col("prov_rank")).alias("provenance"), "prov_rank", "count", (F.col("first") == 1).alias("is_new"), (F.col("prov_rank") > F.coalesce("was", F.col("prov_rank"))).alias("upgraded"))
    )


def by_register(words: DataFrame, register: str = "register") -> DataFrame:
    return words.groupBy("word", register).agg(F.count(F.lit(1)).alias("count"))


def word_sources(words: DataFrame, doc: str = "doc_id", seen: str | None = None) -> DataFrame:
    """Each word with each document that holds it, and when it was first seen there."""
    first = F.min(seen) if seen else F.lit(None).cast("timestamp")
    return words.groupBy("word", F.col(doc).alias("doc")).agg(first.alias("first_seen"))


def document_counts(sources: DataFrame) -> DataFrame:
    return sources.groupBy("word").agg(F.count(F.lit(1)).alias("sources"))


def day_counts(sources: DataFrame) -> DataFrame:
    """Distinct days on which a word was first seen in a document: what the checker trusts."""
    return sources.select("word", F.to_date("first_seen").alias("day")).distinct().groupBy("word").agg(F.count("day").alias("days"))


def validity(provenance: Column, sources: Column) -> Column:
    """Prior of the provenance, raised by independent sources."""
    base = F.create_map(*chain.from_iterable((F.lit(n), F.lit(p)) for n, p in PROVENANCE))[provenance]
    return F.least(base + (1 - base) * (sources / (sources + F.lit(2.0))) * 0.5, F.lit(1.0))


def classify(provenance: Column, in_dictionary: Column, stored: Column | None = None) -> Column:
    """``word`` or ``name``; a stored kind wins, then the dictionary, then where the word came from."""
    kind = F.when(in_dictionary, "word").when(provenance.isin("owned", "tap", "installed", "dependency"), "name").otherwise("word")
    return kind if stored is None else F.coalesce(stored, kind)


def listing(lexicon: DataFrame, sources: DataFrame, dictionary: DataFrame, needle: str | None = None, limit: int | None = None) -> DataFrame:
    """Entries by falling count, then word; ``needle`` as in LIKE, folded to one case."""
    kept = lexicon if needle is None else lexicon.where(F.col("word").ilike(f"%{needle}%"))
    counts = sources if "sources" in sources.columns else document_counts(sources)
    rows = kept.join(counts, "word", "left").join(dictionary.select("word", F.lit(True).alias("listed")), "word", "left")
    n = F.coalesce("sources", F.lit(0))
    out = rows.select("word", "provenance", "count", n.cast("long").alias("sources"), validity(F.col("provenance"), n).alias("validity"), classify(F.col("provenance"), F.coalesce("listed", F.lit(False))).alias("kind"))
    out = out.orderBy(F.desc("count"), "word")
    return out if limit is None else out.limit(limit)


def dictionary_from(words: DataFrame, doc: str = "doc_id", least: int = 3) -> DataFrame:
    """A dictionary ``word, level`` from a corpus: words of at least ``least`` documents, commoner words at lower levels."""
    return levelled(words.select("word", doc).distinct().groupBy("word").agg(F.count(F.lit(1)).alias("docs")), least)


def levelled(counts: DataFrame, least: int = 3) -> DataFrame:
    """The same from ``word, docs``."""
    spread = counts.where(F.col("docs") >= least)
    level = F.when(F.col("docs") >= LEVELS[0][0], LEVELS[0][1])
    for at, value in LEVELS[1:]:
        level = level.when(F.col("docs") >= at, value)
    level = level.otherwise(60)
    return spread.select("word", level.cast("int").alias("level"))
