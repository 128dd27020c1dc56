"""A training corpus from raw documents: five stages, each one operator of ``inkwell.llm``.

Each stage takes the documents that the one before kept and returns those it keeps, with the columns of ``documents``; the last
returns token ids. Stages are written as Parquet and read again between each other, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import bpe, language, mixing, quality, similar
from inkwell.llm.common import scratch_path, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is known: evidence of text, declared language and source together is sure enough.

    Null and empty texts, and texts without letters, are rejected; null languages and sources give no evidence; repeated rows are judged alike. Extra columns are left out.
    """
    model = language.train(docs.select("text", "lang"))
    out = language.identify(_documents(docs), model, declared=F.col("lang"), host=F.col("source"))
    return _documents(out.where("accepted"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose Bradley-Terry score reaches the cut.

    Null and empty texts have a score like any other; ids may be null or repeated; without labels of both kinds every document stays. Extra columns are left out.
    """
    ranker = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return _documents(quality.scored(_documents(docs), ranker).where(F.col("score") >= quality.CUT))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near copies (five-word shingles, similarity 0.8): the one with the least id.

    Rows that repeat id and text are one document; unlike texts that share an id both stay; of copies without an id one stays, unless a copy has an id.
    Null and empty texts are copies of each other.
    """
    return similar.one_of_each(_documents(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thin languages out to flattened shares of the tokens; a document is used once at most.

    Documents with one id stay or go together, those without an id by their text's hash; texts without words are no tokens of any language. Extra columns are left out.
    """
    name = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64(F.lit("none"), F.col("text")))
    named = docs.withColumn("name", name)
    labels = table(spark, sf_dir, "labels").where("doc_id is not null").select(F.xxhash64("doc_id").alias("name"))
    rates = mixing.rates(named.select("name", "text", "lang"), labels, key="name", most=1.0)
    gone = rates.groupBy("name").agg(F.max("copies").alias("copies")).where("copies = 0").select("name")
    return _documents(named.join(gone, "name", "left_anti"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each kept document; none for a null or empty text. Repeated rows and null ids stay rows."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), keep=False).withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("tokenize", tokenize),
]

#: Trained classifiers, fingerprints and byte-pair merges can't be written as SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        (made := stage(spark, docs, sf_dir)).write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
