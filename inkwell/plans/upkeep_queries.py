"""Queries over what waits to be learned, who the user is, and the dictionaries that are written."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import identity, maintain, spool, targets, vocabulary
from inkwell.plans import sql
from inkwell.plans.lexicon_queries import vocabulary_of
from inkwell.plans.text_queries import WORDS, read

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


_SPOOL = "spool AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN conv_id % 2 = 0 THEN 'slack' ELSE 'prompt' END AS register, CASE WHEN conv_id % 3 <> 0 THEN 'c' || conv_id END AS source, text AS body, CASE WHEN role = 'assistant' THEN 'other' ELSE 'user' END AS authored_by FROM conversations)"
_PENDING = "pending AS (SELECT id, register, body, authored_by, coalesce(source, 'capture') || '#' || id AS doc FROM spool ORDER BY id LIMIT 500)"


def waiting(spark, sf_dir):
    """Conversations as a spool."""
    rows = read(spark, sf_dir, "conversations")
    source = F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    register = F.when(F.col("conv_id") % 2 == 0, "slack").otherwise("prompt")
    by = F.when(F.col("role") == "assistant", "other").otherwise("user")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("id"), register.alias("register"), source.alias("source"), F.col("text").alias("body"), by.alias("authored_by"), F.lit(None).cast("string").alias("author"))


@query("spool_pending", f"WITH {_SPOOL}, {_PENDING} SELECT * FROM pending")
def spool_pending(spark, sf_dir):
    return spool.pending(waiting(spark, sf_dir))


@query("spool_retired", f"WITH {_SPOOL}, {_PENDING} SELECT register, authored_by, count(*) AS n, min(id)::BIGINT AS first FROM spool WHERE id NOT IN (SELECT id FROM pending) GROUP BY register, authored_by")
def spool_retired(spark, sf_dir):
    _, left = spool.drain(waiting(spark, sf_dir))
    return left.groupBy("register", "authored_by").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


@query(
    "commit_identities",
    "SELECT DISTINCT lower(c_name) || '@n' || c_nationkey AS handle, 'commits' AS source FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS n FROM customer) WHERE n <= 40 AND c_custkey IN (SELECT o_custkey FROM orders)",
)
def commit_identities(spark, sf_dir):
    """Customers as authors of commits, nations as repositories; known are those who have ordered."""
    customer = read(spark, sf_dir, "customer")
    commits = customer.select(F.col("c_nationkey").alias("repository"), (-F.col("c_custkey")).alias("place"), F.col("c_name").alias("author"), F.concat("c_name", F.lit("@n"), F.col("c_nationkey").cast("string")).alias("email"))
    known = customer.join(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select(F.col("c_name").alias("handle"))
    return identity.from_commits(commits, known)


@query(
    "target_status",
    f"WITH {WORDS}, {sql.dictionary()} SELECT 'vscode' AS name, true AS present, count(*) AS ours, count(*) AS total FROM dict UNION ALL SELECT 'wisprflow', false, 0, 0 UNION ALL SELECT 'macos', true, (SELECT count(*) FROM dict WHERE level >= 55), count(DISTINCT word) FROM words",
)
def target_status(spark, sf_dir):
    """A dictionary that is ours, one that was never written, and one in which our words are some of the user's."""
    words = vocabulary_of(spark, sf_dir)
    own, rows = vocabulary.levelled(words), words.select("word")
    name = lambda df, n: df.select(F.lit(n).alias("name"), "word")
    return targets.statuses(name(own, "vscode").unionByName(name(rows, "macos")), name(own, "vscode").unionByName(name(own.where("level >= 55"), "macos")))


@query("own_vocabulary", f"WITH {WORDS}, {sql.dictionary()} SELECT word, count(*) AS count FROM words WHERE word NOT IN (SELECT word FROM dict WHERE level >= 55) GROUP BY word")
def own_vocabulary(spark, sf_dir):
    """Word counts without names; the rarer dictionary words stand for names."""
    words = vocabulary_of(spark, sf_dir)
    return maintain.counts_without_names(words.select("word", F.col("n").alias("count")), vocabulary.levelled(words).where("level >= 55"))
