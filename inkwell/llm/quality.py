"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of text features. Preference pairs put a labelled good document before
a labelled poor one; logistic loss on the difference of their features fits the weights. The decision
threshold is a quantile of the training scores: the share of poor documents among the labelled rows. Scores are
strengths on a logistic scale, shifted so that this quantile falls on ``CUT``; higher means label 1 is likelier.

Training reads labelled rows outside the held-out fold only, at most ``TRAIN_ROWS`` of them by hash order (a documented bound;
all rows when fewer), and ``PAIRS`` pairs. Scoring covers every whole text. Labels, language, source and id are never inputs.

Edge cases: a null or empty text has all-zero features and so gets a score like any other; repeated rows stay; very long texts are
read line by line; an empty table gives an empty table; labels of one class only, or none, give every text the score 0.5.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

FOLDS = 5
CUT = 0.3
TRAIN_ROWS = 20_000
PAIRS = 200_000

_MARKED = re.compile(r"[^\w\s]{2,}(?=\s|$)")
_SHOUT = re.compile(r"\b[^\W\d_a-zß-ÿ]{2,}\b")
_STUTTER = re.compile(r"(?<!\S)(\S+)(?: \1(?!\S)){2,}")
_BAR = re.compile(r" \| ")
_DIGIT = re.compile(r"\d")
_ODD = re.compile(r"[^\w\s.,;:!?'\"()\-]")

FEATURES = (
    "marked", "shout", "stutter", "bars", "digits", "odd", "distinct", "word_length", "line_length", "longest_word", "upper", "stops", "same_lines", "any_marked", "any_shout", "any_stutter", "any_bars", "log_words", "spread", "comma",
)


def features(text: str | None) -> list[float]:
    """Shares and counts that describe how a text is made, not what it says."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = len(text)
    lines = text.split("\n")
    marked, shout, bars = len(_MARKED.findall(text)), len(_SHOUT.findall(text)), len(_BAR.findall(text)) + text.count(" |\n") + text.endswith(" |")
    stutter = sum(len(m.group(0).split(" ")) for m in _STUTTER.finditer(text))
    distinct = len(set(words))
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    squares = sum(x * x for x in lengths) / n - mean * mean
    return [
        marked / n,
        shout / n,
        stutter / n,
        bars / n,
        len(_DIGIT.findall(text)) / chars,
        len(_ODD.findall(text)) / chars,
        distinct / n,
        math.log1p(mean),
        math.log1p(chars / len(lines)),
        math.log1p(max(lengths)),
        sum(map(str.isupper, words)) / n,
        sum(w[-1] in ".!?" for w in words) / n,
        1 - len(set(lines)) / len(lines),
        math.log1p(marked),
        math.log1p(shout),
        math.log1p(stutter),
        math.log1p(bars),
        math.log1p(n),
        math.sqrt(max(squares, 0.0)) / mean,
        text.count(",") / n,
    ]


def held_out(key: str = "doc_id", folds: int = FOLDS):
    """Whether a row is in the fold that training never sees."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(False))


@dataclass(frozen=True)
class Ranker:
    """Fitted weights: strength = (features - centre) / scale . weights."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        shifted = np.clip(self.strength(x) - self.threshold + math.log(CUT / (1 - CUT)), -700, 700)
        return 1 / (1 + np.exp(-shifted))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 7) -> Ranker:
    """Bradley-Terry weights from features and labels; Newton steps on the pairs' logistic loss."""
    width = x.shape[1] if x.ndim == 2 else len(FEATURES)
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(poor):
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), math.log(CUT / (1 - CUT)))
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.clip((x - centre) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    # every document takes part as evenly as the number of pairs allows
    deal = lambda ids: np.concatenate([rng.permutation(ids) for _ in range(-(-pairs // len(ids)))])[:pairs]
    d = z[deal(good)] - z[deal(poor)]
    w = np.zeros(width)
    loss = lambda v: np.logaddexp(0, -(d @ v)).mean() + ridge / 2 * v @ v
    now = loss(w)
    for _ in range(60):
        p = 1 / (1 + np.exp(np.clip(d @ w, -700, 700)))
        gradient = -(d * p[:, None]).mean(axis=0) + ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(width)
        step = np.linalg.solve(curve, gradient)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w, before, now = w - size * step, now, loss(w - size * step)
        if before - now < 1e-9:
            break
    strengths = np.sort(z @ w)
    # halfway between the two scores that the quantile falls between
    k = min(max(len(poor), 1), len(strengths) - 1)
    return Ranker(centre, scale, w, float((strengths[k - 1] + strengths[k]) / 2))


def _matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=float).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Ranker:
    """Fit on labelled rows outside the held-out fold. Features are computed where the texts are; at most ``rows`` of them come to the driver."""
    marks = labels.where(F.col(label).isin(0, 1) & ~held_out(key)).groupBy(key).agg(F.max(label).alias("y"))
    chosen = marks.orderBy(F.xxhash64(F.col(key)), key).limit(rows)
    feature_rows = F.pandas_udf(lambda s: s.map(features), "array<double>")
    # ``rows`` keys at most: broadcasting is safe, and texts are not shuffled
    picked = docs.select(key, text).join(F.broadcast(chosen), key)
    got = picked.select("y", feature_rows(F.coalesce(F.col(text), F.lit(""))).alias("x"), F.col(key).alias("k")).orderBy("k", F.hash("x")).limit(rows).toPandas()
    if not len(got):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.stack(got["x"].map(np.asarray).tolist()), got["y"].to_numpy())


def scored(df: DataFrame, ranker: Ranker, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score of each whole text."""
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {out} exists already")

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(ranker.score(_matrix(texts)))

    return df.withColumn(out, score(F.coalesce(F.col(text), F.lit(""))))


def op10_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranker = train(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, ranker)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op10_bradley_terry": op10_bradley_terry}
ORACLES: dict[str, str] = {}
