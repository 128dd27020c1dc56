"""Who the user is, as their tools say: hosts files, git settings and commit logs, given as tables of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COMMITS_PER_REPOSITORY = 40


def from_hosts(files: DataFrame, column: str = "text") -> DataFrame:
    """``handle, source`` of ``hosts.yml`` texts: the keys right below each ``users:`` entry, four spaces deeper than it."""
    blocks = files.select(F.explode(F.regexp_extract_all(F.regexp_replace(column, "\r", ""), F.lit(r"(?m)(^ *users:[ ]*$(?:\n(?: *$| +.*))*)"), F.lit(1))).alias("block"))
    # lines that are not deeper than ``users:`` end its part
    own = blocks.select(F.length(F.regexp_extract("block", "^( *)", 1)).alias("at"), F.split("block", "\n").alias("ls"))
    deeper = F.transform("ls", lambda x: (F.trim(x) == "") | (F.length(F.regexp_extract(x, "^( *)", 1)) > F.col("at")))
    held = own.select("at", "ls", F.array_position(F.slice(deeper, F.lit(2), F.size("ls")), False).alias("end"))
    held = held.select("at", F.slice("ls", F.lit(2), F.when(F.col("end") > 0, F.col("end") - 1).otherwise(F.size("ls")).cast("int")).alias("ls"))
    lines = held.select("at", F.explode("ls").alias("l"))
    found = lines.where(F.length(F.regexp_extract("l", "^( *)", 1)) == F.col("at") + 4).select(F.regexp_extract(F.trim("l"), "^(.+):$", 1).alias("handle"))
    return found.where("handle <> ''").distinct().select("handle", F.lit("gh").alias("source"))


def from_settings(lines: DataFrame, column: str = "line") -> DataFrame:
    """``handle, source`` of git settings (``user.name=…``, ``user.email=…``)."""
    value = F.trim(F.regexp_extract(column, r"^\s*user\.(?:name|email)\s*=\s*(.*)$", 1))
    return lines.select(value.alias("handle")).where("handle <> ''").distinct().select("handle", F.lit("gitconfig").alias("source"))


def from_commits(commits: DataFrame, known: DataFrame, most: int = COMMITS_PER_REPOSITORY) -> DataFrame:
    """``handle, source``: addresses in the last commits (``repository, place, author, email``; place 0 is the newest) by anyone whose name is a known handle.

    Only the newest ``most`` commits of a repository count; each is ranked within its repository.
    """
    newest = F.row_number().over(Window.partitionBy("repository").orderBy("place"))
    recent = commits.withColumn("n", newest).where(F.col("n") <= most)
    rows = recent.select(F.lower(F.trim("author")).alias("who"), F.lower(F.trim("email")).alias("handle")).where(F.col("handle").contains("@")).distinct()
    return rows.join(known.select(F.lower("handle").alias("who")).distinct(), "who", "left_semi").select("handle", F.lit("commits").alias("source")).distinct()
