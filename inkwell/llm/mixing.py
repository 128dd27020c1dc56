"""Mixing sources to target weights with soft memberships.

A naive Bayes classifier of hashed words, fitted on a labelled table, gives each document a posterior over domains. Document rates
``r >= 0`` then solve a least-squares problem: the expected tokens of each domain, ``sum_i r_i n_i p_id``, should equal the domain's
target, with the rates starting from one. Each step of the projected gradient is one aggregation over all documents (domain totals and their
Gram matrix, which scales the step); the state of a document is an expression of its posterior and a few numbers
for each step, so nothing but those sums reaches the driver.

Only DataFrame functions run here. Words are scored against a broadcast table of ``SLOTS`` rows (a fixed size) and summed for each
document before any shuffle.

Edge cases: a text without words has no tokens, the prior as posterior, and the rate that follows from it; every label is a
domain, and a target for a domain without labelled rows is an error (sums grow with the square of their number); a labelled table without labels gives one domain, and so the rate one times its target's share; rows that repeat
an id are rows of their own; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialise, table, unit_hash

SLOTS = 4096
#: Labelled rows that a domain is learned from, about.
TRAIN_ROWS = 1000
#: A text speaks with the evidence of so many words at most: memberships stay soft.
EVIDENCE = 24.0
FLATTEN = 0.9
STEPS = 12
#: A document is repeated so often at most.
MOST_COPIES = 4.0
SEED = 11


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")


def _slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, domain: str, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """``text, domain, of`` of rows of ``docs`` whose keys are in ``labels``: all of a domain of up to ``rows`` (``of``), about ``rows`` of a larger one, by a seeded hash of the key."""
    named = docs.where(F.col(key).isNotNull() & F.col(domain).isNotNull()).select(F.col(key), F.col(domain).cast("string").alias("domain"), F.col(text).alias("text"))
    known = materialise(named.select(key, "domain").join(labels.select(key).distinct(), key, "left_semi"), "mixing-labelled")
    sizes = known.groupBy("domain").agg(F.count(F.lit(1)).alias("of"))
    # one row for each domain: broadcasting is safe
    chosen = known.join(F.broadcast(sizes), "domain").where(unit_hash(F.lit(SEED), F.col(key)) * F.col("of") < rows).distinct()
    return named.join(materialise(chosen, "mixing-chosen"), [key, "domain"]).select("text", "domain", "of")


def fit_classifier(sample: DataFrame) -> tuple[list[str], DataFrame, list[float]]:
    """Domains, their word table (``slot, w``: log-probabilities for each domain; ``SLOTS`` rows) and log-priors from ``of``. Every label of the sample is a domain."""
    sizes = sample.groupBy("domain").agg(F.max("of").alias("n")).collect()
    domains = sorted(r["domain"] for r in sizes) or ["all"]
    priors = {r["domain"]: r["n"] for r in sizes}
    total = sum(priors.values())
    tokens = sample.select("domain", F.explode(_words("text")).alias("w")).groupBy("domain", _slot(F.col("w")).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    tokens = materialise(tokens, "mixing-words")
    sums = {r["domain"]: r["t"] for r in tokens.groupBy("domain").agg(F.sum("n").alias("t")).collect()}
    spark = sample.sparkSession
    slots = spark.range(SLOTS).select(F.col("id").cast("int").alias("slot"))
    by_slot = tokens.groupBy("slot").agg(*[F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).alias(f"n{i}") for i, d in enumerate(domains)])
    logs = [F.log((F.coalesce(F.col(f"n{i}"), F.lit(0)) + 0.5) / F.lit(float(sums.get(d, 0)) + 0.5 * SLOTS)).alias(f"w{i}") for i, d in enumerate(domains)]
    model = slots.join(by_slot, "slot", "left").select("slot", *logs)
    return domains, materialise(model, "mixing-model"), [math.log((priors.get(d, 0) + 1) / (total + len(domains))) for d in domains]


def posteriors(docs: DataFrame, classifier: tuple[list[str], DataFrame, list[float]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``rid, key, n_tokens, p`` for each row; ``rid`` is the row's position, so repeated keys stay apart."""
    domains, model, priors = classifier
    k = len(domains)
    # the position first: beside the explosion it would number words
    placed = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key), F.col(text).alias("t"))
    rows = placed.select("rid", key, F.explode_outer(_words("t")).alias("w"))
    rows = rows.withColumn("slot", F.when(F.col("w").isNotNull(), _slot(F.col("w"))))
    # SLOTS rows whatever the input: broadcasting is safe
    scored = rows.join(F.broadcast(model), "slot", "left").groupBy("rid", key).agg(F.count("w").alias("n_tokens"), *[F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(k)])
    soften = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.greatest(F.col("n_tokens"), F.lit(1)))
    log = F.array(*[F.lit(priors[i]) + F.col(f"s{i}") * soften for i in range(k)])

    def normal(x: Column) -> Column:
        return let(F.array_max(x), lambda top: let(F.transform(x, lambda v: F.exp(v - top)), lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda s: F.transform(e, lambda v: v / s))))

    return scored.select("rid", key, F.col("n_tokens").cast("long"), let(log, normal).alias("p"))


def natural_targets(totals: list[float], flatten: float = FLATTEN) -> list[float]:
    """Token targets whose shares are the domains' own shares to the power ``flatten``, at the greatest total that needs no document more than once."""
    whole = sum(totals)
    if not whole:
        return [0.0] * len(totals)
    shares = [t / whole for t in totals]
    flat = [s**flatten if s > 0 else 0.0 for s in shares]
    flat = [f / sum(flat) for f in flat]
    budget = whole * min(s / f for s, f in zip(shares, flat, strict=True) if f > 0)
    return [budget * f for f in flat]


def _dot(p: Column, numbers: list[float]) -> Column:
    return sum((F.get(p, i) * F.lit(float(x)) for i, x in enumerate(numbers[1:], 1)), F.get(p, 0) * F.lit(float(numbers[0])))


def fit_rates(table_: DataFrame, domains: int, targets: list[float] | None = None, most: float | None = None, steps: int = STEPS, tolerance: float = 1e-6) -> tuple[Column, list[float], list[float]]:
    """Rate as an expression of ``p``, the targets, and the totals that the rates reach. ``most``: rates stay at or below it."""
    p, n = F.col("p"), F.col("n_tokens")
    rate: Column = F.lit(1.0)
    reached: list[float] = []
    for _ in range(steps + 1):
        # the rate once for each row, whatever the number of sums
        now = table_.select("p", "n_tokens", rate.alias("now"))
        weight = (n * F.col("now")).cast("double")
        sums = [F.sum(weight * F.get(p, i)).alias(f"t{i}") for i in range(domains)]
        inside = F.col("now") > 0 if most is None else (F.col("now") > 0) & (F.col("now") < most)
        free = F.when(inside if reached else F.lit(True), n.cast("double")).otherwise(0.0)
        gram = [F.sum(free * F.get(p, i) * F.get(p, j)).alias(f"g{i}_{j}") for i in range(domains) for j in range(i + 1)]
        got = now.agg(*sums, *gram).first().asDict()
        reached = [got[f"t{i}"] or 0.0 for i in range(domains)]
        if targets is None:
            targets = natural_targets(reached)
        gap = np.array(reached) - np.array(targets)
        if not sum(targets) or np.abs(gap).max() <= tolerance * sum(targets):
            break
        g = np.array([[got[f"g{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(domains)] for i in range(domains)])
        step = np.linalg.lstsq(g + 1e-9 * np.trace(g) * np.eye(domains), gap, rcond=None)[0]
        rate = F.greatest(F.lit(0.0), rate - _dot(p, step.tolist()))
        rate = rate if most is None else F.least(F.lit(float(most)), rate)
    return F.round(rate, 9), targets, reached


def copies(rate: Column, *key: Column, seed: int = SEED) -> Column:
    """Whole copies of a document: the rate's whole part, and one more with the probability of the rest, by a seeded hash of the key."""
    return (F.floor(rate) + F.when(unit_hash(F.lit(seed), *key) < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def rates(docs: DataFrame, labels: DataFrame, domain: str = "lang", key: str = "doc_id", text: str = "text", targets: dict[str, float] | None = None, most: float | None = MOST_COPIES, weight: float | None = None) -> DataFrame:
    """``key, n_tokens, domains, p, rate, copies`` for each row of ``docs``. ``targets``: tokens for each domain; ``most``: greatest rate.

    With ``weight``, each domain's target is an equal part of all tokens times ``weight``.
    """
    classifier = fit_classifier(labelled_sample(docs, labels, domain, key, text))
    names = classifier[0]
    if targets and (unknown := sorted(set(targets) - set(names))):
        raise ValueError(f"no labelled rows for the targeted domains {unknown}")
    scored = materialise(posteriors(docs, classifier, key, text), "mixing-posteriors")
    if weight is not None:
        whole = scored.agg(F.sum("n_tokens")).first()[0] or 0
        targets = {d: weight * whole / len(names) for d in names}
    rate, _, _ = fit_rates(scored, len(names), [float(targets.get(d, 0.0)) for d in names] if targets else None, most)
    out = scored.select("rid", key, "n_tokens", F.array(*[F.lit(d) for d in names]).alias("domains"), "p", rate.alias("rate"))
    return out.withColumn("copies", copies(F.col("rate"), F.col(key), F.when(F.col(key).isNull(), F.col("rid")))).drop("rid")


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are the domains; the stated weights are equal: each source is to give the same part of all tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return rates(docs, table(spark, sf_dir, "labels"), "source", weight=1.0)


QUERIES = {"op9_soft_mixing": op9_soft_mixing}
ORACLES: dict[str, str] = {}
