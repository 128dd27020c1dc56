"""Two-pass external shuffle into shards.

Pass one scatters records uniformly over memory-sized buckets by a seeded hash; pass two
shuffles each bucket by Fisher-Yates and writes it. The concatenated buckets are one
permutation of the whole table, cut into shards of equal row counts.

Only DataFrame functions run here. ``shuffle`` is Spark's own Fisher-Yates over an array;
every bucket is one partition, so the generator's seed is the given seed plus the bucket. Records move once, whatever the
input's size: a bucket's place in the permutation travels to it as a row of the same exchange, so nothing is joined or broadcast there.

A record's bucket follows from its key. Keys without a value, and keys whose records would fill half a bucket or more (there are
at most two for each bucket), are scattered by row position as well, so copies of one key share no bucket. The permutation is
repeatable for the same files, seed and ``bucket_bytes``.

Edge cases: a null text counts as empty (size 8, checksum 0). Rows that repeat an id stay separate
rows; within a bucket the order before the shuffle is that of key and all other columns' hash, so only rows equal in everything are
interchangeable (columns that hold maps are left out of the hash). An empty table gives empty shards. A text beyond ``bucket_bytes`` makes
its bucket larger by that text. Extra columns are carried along, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, table

#: Bounds of a bucket's bytes, and the part of a task's memory that it may take: its rows are held a few times over.
LEAST_BUCKET, MOST_BUCKET, MEMORY_PART = 8 << 20, 256 << 20, 96
SEED = 20_240_601
GROUP = 1 << 10


def default_bucket_bytes(spark: SparkSession) -> int:
    """A bucket that a task of the session's executors can hold."""
    local = spark.sparkContext.master.split("[")[0] == "local"
    memory = spark.sparkContext.getConf().get("spark.driver.memory" if local else "spark.executor.memory", "1g")
    cores = spark.sparkContext.defaultParallelism if local else int(spark.sparkContext.getConf().get("spark.executor.cores", "1"))
    share = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(memory) // max(cores, 1)
    return min(max(share // MEMORY_PART, LEAST_BUCKET), MOST_BUCKET)


def shard_of(position, rows: int, shards: int):
    """Shard of a global position; shard ``s`` starts at ``ceil(s * rows / shards)``."""
    return F.floor(position * F.lit(shards) / F.lit(max(rows, 1))).cast("int")


def _starts(counts: DataFrame) -> DataFrame:
    """``bucket, start``: rows of all buckets before each, by sums within groups of buckets and over groups."""
    grouped = counts.withColumn("g", F.expr(f"bucket div {GROUP}"))
    within = grouped.select("g", "bucket", F.expr("sum(n) over (partition by g order by bucket) - n").alias("inner_"))
    groups = grouped.groupBy("g").agg(F.sum("n").alias("n")).select("g", F.expr("sum(n) over (order by g) - n").alias("outer_"))
    return within.join(groups, "g").select("bucket", (F.col("inner_") + F.col("outer_")).alias("start"))


def external_shuffle(
    df: DataFrame, path: str, key: str = "doc_id", text: str = "text", shards: int = 24, bucket_bytes: int | None = None, seed: int = SEED
) -> DataFrame:
    """Write a seeded permutation of ``df`` as Parquet under ``path`` (one folder per shard) and return what was written.

    The result has one column ``record`` (the row as it came), ``shard`` and ``slot``: the row's place in its shard,
    without gaps from 0. Row counts of shards differ by one at most. ``df`` must give its rows in the same order whenever it is
    read, as tables in files do.
    """
    spark = df.sparkSession
    bucket_bytes = bucket_bytes or default_bucket_bytes(spark)
    own = F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 8
    keyed = df.select(F.xxhash64(F.lit(seed), F.col(key)).alias("kh"), F.col(key).isNull().alias("loose"), own.alias("size"))
    by_key = keyed.groupBy("kh", "loose").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    rows, size = (int(x or 0) for x in by_key.agg(F.sum("n"), F.sum("size")).first())
    buckets = max(1, math.ceil(size / bucket_bytes))
    heavy = by_key.where(~F.col("loose") & (F.col("n") > 1) & (F.col("size") * 2 >= bucket_bytes)).select("kh", F.lit(True).alias("heavy"))
    hashed = [f"`{f.name}`" for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    placed = df.select(F.xxhash64(F.lit(seed), F.col(key)).alias("kh"), F.monotonically_increasing_id().alias("at"), F.struct(F.col(key).alias("k"), F.xxhash64(*hashed).alias("h"), whole.alias("record")).alias("r"))
    # two heavy keys a bucket at most: 16 bytes each, whatever the rows
    marked = placed.join(F.broadcast(heavy), "kh", "left")
    spread = F.when(F.col("heavy") | F.col("r.k").isNull(), F.col("at"))
    scattered = marked.select(F.pmod(F.xxhash64(F.lit(seed), F.col("kh"), spread), F.lit(buckets)).cast("int").alias("bucket"), "r")
    starts = _starts(scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")))
    nothing = F.lit(None)
    travelling = scattered.select("bucket", "r", nothing.cast("long").alias("start")).unionByName(starts.select("bucket", nothing.cast(scattered.schema["r"].dataType).alias("r"), "start"))
    dealt = (
        travelling.repartitionById(buckets, F.col("bucket"))
        .groupBy("bucket")
        .agg(F.collect_list("r").alias("rs"), F.max("start").alias("start"))
        # a fixed order first: rows arrive in any order, and the permutation must not depend on it
        .select("start", F.shuffle(F.array_sort("rs", lambda a, b: _order(a, b)), F.lit(seed)).alias("rs"))
    )
    position = F.col("start") + F.col("pos")
    out = (
        dealt.select("start", F.posexplode("rs").alias("pos", "r"))
        .select(F.col("r.record").alias("record"), position.alias("p"), shard_of(position, rows, shards).alias("shard"))
        .select("record", "shard", (F.col("p") - F.ceil(F.col("shard") * F.lit(rows) / F.lit(shards))).alias("slot"))
    )
    out.write.partitionBy("shard").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def _order(a, b):
    """By key, then by the whole row's hash; nulls first."""
    return F.when(a["k"].isNull() & b["k"].isNotNull(), -1).when(a["k"].isNotNull() & b["k"].isNull(), 1).when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0)


def op7_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = external_shuffle(docs, scratch_path(spark, "shards"))
    raw = F.coalesce(F.col("record.text"), F.lit(""))
    return out.select(
        F.col("record.doc_id").alias("doc_id"),
        (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op7_two_pass_shuffle": op7_two_pass_shuffle}
ORACLES: dict[str, str] = {}
