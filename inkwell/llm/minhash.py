"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits.

Each word shingle is hashed once; the hash's high bits name one of ``BINS`` bins and each bin keeps its least hash. An
empty bin takes the value of a bin that a universal hash of (bin, attempt) names: the first of a few attempts that is not
empty, else the non-empty bin that ranks first for it, which is where endless attempts would end. The low ``BITS`` bits
of each bin make the fingerprint. Likeness is the share of equal bins, less what equal low bits give by
chance: ``(m - 2^-b) / (1 - 2^-b)``, cut to [0, 1].

Only DataFrame functions run here. A text is split, hashed and packed within its row; no shingle is ever shuffled.

Shingles are ``WORDS`` words of the text as it stands, cut at white space; a shorter text is one shingle. Edge cases: a null text
counts as empty; an empty text has a fingerprint of its own that is like other empty texts (1) and no others (0); rows that
repeat an id are ordered by text; rows with a null id come last; an empty table gives an empty table; a table of one row is its own next row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, table

BINS = 256
BITS = 8
WORDS = 5
ATTEMPTS = 8
#: Rows of one range of ids, about; with more ranges than ``MOST_RANGES`` the ranges grow instead.
RANGE_ROWS = 1024
MOST_RANGES = 20_000
_HIGH = 63 - BINS.bit_length() + 1  # hashes have 63 bits; a bin has this many below its number


def _bin(h: Column) -> Column:
    return F.shiftright(h, _HIGH)


def _last(b: Column) -> Column:
    """The bin's greatest value: stands for an empty bin."""
    return F.shiftleft(b.cast("long"), _HIGH).bitwiseOR(F.lit((1 << _HIGH) - 1))


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """63-bit hashes of the text's word shingles; an empty array for a text without words."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")

    def hashes(ws: Column) -> Column:
        n = F.size(ws)
        each = F.transform(F.sequence(F.lit(0), F.greatest(n - words, F.lit(0))), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(ws, i + k) for k in range(words)]), 1))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(each)

    return let(tokens, hashes)


def _densified(least: Column) -> Column:
    """Fill the empty bins of an array with one value per bin."""
    empty = lambda value, b: value == _last(b)

    def attempt(j: Column, a: int) -> Column:
        at = F.pmod(F.xxhash64(j.cast("int"), F.lit(a)), F.lit(BINS)).cast("int")
        return let(at, lambda b: let(F.get(least, b), lambda v: F.when(~empty(v, b), v)))

    def ranked(full: Column, j: Column) -> Column:
        first = F.array_min(F.transform(full, lambda v: F.struct(F.xxhash64(j.cast("int"), _bin(v), F.lit(-1)).alias("r"), v.alias("v"))))
        return first["v"]

    full = F.filter(least, lambda v: v != _last(_bin(v)))
    return let(full, lambda f: F.transform(least, lambda v, j: F.when(~empty(v, j), v).otherwise(F.coalesce(*[attempt(j, a) for a in range(ATTEMPTS)], ranked(f, j)))))


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """``array<tinyint>`` of the bins' low bits; an empty array for a text without words."""
    marks = F.array(*[F.lit((b + 1 << _HIGH) - 1) for b in range(BINS)])

    def packed(hs: Column) -> Column:
        # with one mark for each bin at its upper end, the first of each bin in sorted order is its least hash, or the mark
        ordered = F.sort_array(F.concat(hs, marks))
        least = let(ordered, lambda s: F.filter(s, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(s, i - 1)))))
        bits = let(least, lambda m: F.transform(_densified(m), lambda v: (v.bitwiseAND(F.lit((1 << BITS) - 1)) - (1 << (BITS - 1))).cast("tinyint")))
        return F.when(F.size(hs) == 0, F.array().cast("array<tinyint>")).otherwise(bits)

    return let(shingle_hashes(text, words), packed)


def as_text(fp: Column) -> Column:
    """The packed bins as hexadecimal digits."""
    return F.lower(F.array_join(F.transform(fp, lambda b: F.lpad(F.hex(b.cast("int") + (1 << (BITS - 1))), BITS // 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two fingerprints."""
    chance = 1.0 / (1 << BITS)
    share = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(BINS))
    estimate = F.greatest(F.lit(0.0), (share - chance) / (1 - chance))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(estimate)


def in_ranges(df: DataFrame, key: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``range``: 0 holds the greatest keys, a null key is in the last. Bounds are quantiles of the keys, a few numbers on the driver."""
    ranges = min(max(1, -(-df.count() // range_rows)), MOST_RANGES)
    bounds = sorted(set(df.stat.approxQuantile(key, [k / ranges for k in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    if not bounds:
        return df.withColumn("range", F.lit(0))
    held = F.array(*[F.lit(float(b)) for b in bounds])
    place = F.when(F.col(key).isNull(), len(bounds) + 1).otherwise(F.lit(len(bounds)) - _below(held, F.col(key).cast("double"), len(bounds)))
    return df.withColumn("range", place.cast("int"))


def _order(key: str, tie: str):
    return Window.partitionBy("range").orderBy(F.col(key).desc_nulls_last(), F.col(tie))


def followers(placed: DataFrame, key: str, tie: str) -> DataFrame:
    """For each range the row that follows its last one: the first of the next range that has any, after the last range that of the first."""
    heads = placed.groupBy("range").agg(F.max(key).alias("head"))  # found from keys alone; one row for each range
    every = Window.orderBy("range")
    before = F.coalesce(F.lag("range").over(every), F.max("range").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select("range", "head", before.alias("before"))
    # MOST_RANGES + 1 rows at most: broadcasting is safe
    tied = placed.join(F.broadcast(heads), "range").where(F.col(key).eqNullSafe(F.col("head")))
    first = tied.withColumn("rank", F.row_number().over(_order(key, tie))).where("rank = 1")
    return first.select(F.col("before").alias("range"), *[F.col(c).alias(f"follows_{c}") for c in placed.columns if c != "range"])


def with_next(df: DataFrame, key: str, tie: str, carried: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``next_<column>`` for the ``carried`` columns: those of the next row by descending ``key`` (then ascending ``tie``); after the last row comes the first.

    Rows go to ranges of keys by one shuffle and are ordered there.
    """
    placed = in_ranges(df, key, range_rows)
    w = _order(key, tie)
    led = placed.select("*", F.lead("range").over(w).alias("inside"), *[F.lead(c).over(w).alias(f"led_{c}") for c in carried])
    ends = followers(placed.select("range", key, *{tie, *carried} - {key}), key, tie).select("range", *[f"follows_{c}" for c in carried])
    joined = led.join(ends, "range", "left")
    chosen = [F.when(F.col("inside").isNotNull(), F.col(f"led_{c}")).otherwise(F.col(f"follows_{c}")).alias(f"next_{c}") for c in carried]
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *chosen)


def _below(bounds: Column, value: Column, n: int) -> Column:
    """How many of the ascending bounds are less than the value, by halving."""
    def further(step: int):
        # a lambda of one argument: a second one would get the element's index
        return lambda x: F.when(F.coalesce(F.get(bounds, x + step - 1) < value, F.lit(False)), x + step).otherwise(x)

    at = F.lit(0)
    for k in reversed(range(n.bit_length())):
        at = let(at, further(1 << k))
    return at


def op4_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    placed = in_ranges(docs.withColumn("tie", F.xxhash64("text")), "doc_id")
    w = _order("doc_id", "tie")
    # a fixed number of partitions: what follows works hard on few bytes, and would be joined into few tasks
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    led = placed.repartition(tasks, "range").withColumn("led", F.lead("text").over(w))
    # fingerprints of the few rows that open a range; all others come from the window below
    ends = followers(placed, "doc_id", "tie").select("range", F.col("follows_text").alias("end"), fingerprint(F.col("follows_text")).alias("end_fp"))
    rows = led.join(ends, "range", "left")  # both are dealt by range
    n = F.char_length("text")
    k = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.coalesce("led", "end"), F.lit(1), k))
    made = rows.select("range", "doc_id", "tie", n.cast("long").alias("n_chars"), edited.alias("edited"), fingerprint(F.col("text")).alias("fp"), "end_fp")
    made = made.select("range", "doc_id", "tie", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fp", fingerprint(F.col("edited")).alias("edited_fp"), "end_fp")
    # the same ranges in the same order: no shuffle and no sort
    made = made.withColumn("next_fp", F.coalesce(F.lead("fp").over(w), F.col("end_fp")))
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


QUERIES = {"op4_one_permutation_minhash": op4_one_permutation_minhash}
ORACLES: dict[str, str] = {}
