"""Language identification by Bayesian evidence fusion.

Evidence of a document adds up as log-likelihoods: byte trigrams of its letters, the language that its markup declares, its address
suffix, and a prior for its host. Host priors are smoothed hierarchically: a host's counts lean on its suffix's, a suffix's on those of all
rows. Counts come from one grouped aggregation over every row, by the language that the text alone suggests; the same
aggregation gives how often each language is declared as what.

The class ``und`` (trigrams equally likely) takes texts that no known language explains; ``accepted`` is false for it and
for posteriors below ``SURE``. The text model learns from distinct texts with a declared language: all of a language with up to ``TRAIN_ROWS`` of
them, about so many of a larger one, by the text's hash (a documented bound), so neither copies nor the table's size change which
languages are learned. A text whose declaration the other texts' model contradicts teaches nothing (texts that together make up much of a
language's sample are part of that language).
Scoring reads every whole text and counts cover all rows.

Edge cases: a text without letters (null, empty, digits) gives no text evidence, so it is ``und``; a missing declaration, suffix or host
gives no evidence; hosts of one row lean on their suffix; repeated rows stay; an empty table gives an empty table; with no declared
languages at all everything is ``und``; columns named like those that are added are an error, other columns of any name are carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, unit_hash

UND = "und"
SLOTS = 1 << 15
#: Texts that a language is learned from, about.
TRAIN_ROWS = 1000
LEAST_ROWS = 3
#: Neighbouring trigrams share letters, so each counts for a part only.
TEMPER = 3.0
#: Rows that a parent's shares weigh in a child's.
LEAN = 20.0
SURE = 0.5
BLOCK = 1 << 20
SMOOTH = 0.05
SEED = 5

_KEEP = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def trigrams(text: str | None) -> np.ndarray:
    """Slots of the byte trigrams of a text's lower-cased words, borders included; white space and other signs only separate."""
    raw = (text or "").encode().translate(_KEEP).split()
    if not raw:
        return np.zeros(0, dtype=np.int64)
    b = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8).astype(np.uint32)
    code = b[:-2] | (b[1:-1] << 8) | (b[2:] << 16)
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    logs: np.ndarray  # languages and last ``und`` x slots

    def likelihoods(self, text: str | None) -> np.ndarray:
        slots = trigrams(text)
        total = np.zeros(len(self.languages) + 1)
        for at in range(0, len(slots), BLOCK):
            total += self.logs[:, slots[at : at + BLOCK]].sum(axis=1)
        return total / TEMPER


def fit(counts: dict[str, np.ndarray]) -> TextModel:
    languages = tuple(sorted(counts))
    rows = [np.log((counts[x] + SMOOTH) / (counts[x].sum() + SMOOTH * SLOTS)) for x in languages]
    return TextModel(languages, np.vstack([*rows, np.full(SLOTS, -np.log(SLOTS))]))


def training_texts(df: DataFrame, text: str = "text", declared: str = "lang", rows: int = TRAIN_ROWS) -> DataFrame:
    """``d, t``: distinct texts of each declared language, about ``rows`` of a language with more. Only hashes of texts are shuffled to choose them."""
    given = df.where(F.col(declared).isNotNull() & (F.length(F.col(text)) > 0)).select(F.col(declared).alias("d"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    known = materialise(given.select("d", "h").distinct(), "language-texts")
    sizes = known.groupBy("d").agg(F.count(F.lit(1)).alias("of")).where(F.col("of") >= LEAST_ROWS)
    chosen = materialise(known.join(sizes, "d").where(unit_hash(F.lit(SEED), F.col("h")) * F.col("of") < rows).select("d", "h"), "language-chosen")
    # about ``rows`` pairs of each language: small, but only Spark's own threshold decides on a broadcast, as languages are whatever rows declare
    return given.join(chosen, ["d", "h"]).groupBy("d", "h").agg(F.first("t").alias("t")).select("d", "t")


def _sums(sample: DataFrame, keep) -> dict[str, np.ndarray]:
    """Trigram counts of each language over the texts that ``keep`` (of a declaration and a text's slots) accepts: ``SLOTS`` sums for each language reach the driver."""

    def run(batches):
        found: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                slots = trigrams(t)
                if keep(d, slots):
                    found[d] = found.get(d, 0) + np.bincount(slots, minlength=SLOTS)
                    docs[d] = docs.get(d, 0) + 1
        for d, n in found.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([d] * (len(at) + 1)), pa.array([-1, *at.tolist()], pa.int32()), pa.array([docs[d], *n[at].tolist()], pa.int64())], names=["d", "slot", "n"])

    sums = sample.mapInArrow(run, "d string, slot int, n long").groupBy("d", "slot").agg(F.sum("n").alias("n")).toPandas()
    counts = {}
    for d, part in sums.groupby("d"):
        if int(part.loc[part.slot == -1, "n"].sum()) >= LEAST_ROWS:
            part = part[part.slot >= 0]
            counts[d] = np.bincount(part.slot, weights=part.n, minlength=SLOTS)
    return counts


def train(df: DataFrame, text: str = "text", declared: str = "lang", rows: int = TRAIN_ROWS) -> TextModel:
    """Trigram counts of a bounded sample of declared texts, without those that the rest of the sample contradicts."""
    sample = materialise(training_texts(df, text, declared, rows), "language-sample")
    counts = _sums(sample, lambda d, slots: len(slots) > 0)
    sums = {d: n.sum() for d, n in counts.items()}

    def agrees(d: str, slots: np.ndarray) -> bool:
        """The declared language explains the text best, the text's own counts left out."""
        if d not in counts or not len(slots):
            return False
        at, own = np.unique(slots, return_counts=True)
        best = -np.log(SLOTS) * len(slots)
        score = {x: float((own * np.log((n[at] - (own if x == d else 0) + SMOOTH) / (sums[x] - (len(slots) if x == d else 0) + SMOOTH * SLOTS))).sum()) for x, n in counts.items()}
        return score[d] >= max(best, *score.values())

    return fit(_sums(sample, agrees))


def _normal(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _shares(counts: DataFrame, by: str, languages: list[str]) -> DataFrame:
    """``by`` and its rows for each language, as an array."""
    return counts.where(F.col(by).isNotNull()).groupBy(by).agg(F.array(*[F.sum(F.when(F.col("best") == x, F.col("n")).otherwise(0)).cast("double") for x in languages]).alias(f"{by}_n"))


def identify(df: DataFrame, model: TextModel, text: str = "text", declared: Column | None = None, suffix: Column | None = None, host: Column | None = None) -> DataFrame:
    """Add ``language``, ``posterior``, ``text_language`` and ``accepted`` to every row."""
    if taken := {"language", "posterior", "text_language", "accepted"} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(taken)} exist already")
    known = [*model.languages, UND]
    none = F.lit(None).cast("string")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[(x if x is not None else none).alias(n) for x, n in ((declared, "declared"), (suffix, "suffix"), (host, "host"))])

    body = F.coalesce(F.col("row").getField(text), F.lit(""))

    @F.pandas_udf("string")
    def voice(texts):
        import pandas as pd

        return pd.Series([UND if np.ptp(ll) == 0 else known[int(ll.argmax())] for ll in map(model.likelihoods, texts)], dtype=object)

    counts = rows.select("declared", "suffix", "host", voice(body).alias("best")).groupBy("declared", "suffix", "host", "best").agg(F.count(F.lit(1)).alias("n"))
    # kept as a table, so that the texts are scored once for all sums from it
    counts = materialise(counts, "language-counts")
    totals = {r["best"]: r["n"] for r in counts.groupBy("best").agg(F.sum("n").alias("n")).collect()}
    root = np.array([totals.get(x, 0) for x in known], dtype=float) + 1.0
    root /= root.sum()
    # rows of each language that declare anything: a fixed number for each language
    spoke = {r["best"]: r["n"] for r in counts.where("declared is not null").groupBy("best").agg(F.sum("n").alias("n")).collect()}
    spoke = np.array([spoke.get(x, 0) for x in known], dtype=float)
    joined = rows
    for by in ("host", "suffix", "declared"):
        joined = joined.join(_shares(counts, by, known), by, "left")

    @F.pandas_udf("language string, posterior double, text_language string")
    def fused(texts, h, s, d):
        import pandas as pd

        out = []
        for t, at_host, at_suffix, said in zip(texts, h, s, d, strict=True):
            own = model.likelihoods(t)
            if np.ptp(own) == 0:
                out.append((UND, 1.0, UND))
                continue
            prior = root
            for n in (at_suffix, at_host):
                if n is not None:
                    n = np.asarray(n)
                    prior = (n + LEAN * prior) / (n.sum() + LEAN)
            log = own + np.log(prior)
            if said is not None:
                said = np.asarray(said)
                # how often rows of each language declare this, leaning on how often any row does
                base = (said.sum() + 1.0) / (spoke.sum() + len(known))
                log = log + np.log((said + LEAN * base) / (spoke + LEAN))
            p = _normal(log)
            k = int(p.argmax())
            out.append((known[k], float(p[k]), known[int(own.argmax())]))
        return pd.DataFrame(out, columns=["language", "posterior", "text_language"])

    got = joined.withColumn("x", fused(body, "host_n", "suffix_n", "declared_n"))
    accepted = (F.col("x.language") != UND) & (F.col("x.posterior") >= SURE)
    return got.select("row.*", "x.language", "x.posterior", "x.text_language", accepted.alias("accepted"))


def page_text(html: Column) -> Column:
    """A page's visible words, roughly: scripts, styles, comments and tags become spaces."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;", " ")


def op5_bayesian_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: the declared language is the ``lang`` column, the host is the source; there is no address."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = identify(docs, train(docs), declared=F.col("lang"), host=F.col("source"))
    return out.select("doc_id", F.col("lang").alias("declared"), "text_language", "language", "posterior", "accepted")


def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: markup language, address suffix and host all speak."""
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract(F.lower("url"), r"^[a-z]+://([^/:?#]+)", 1)
    host = F.regexp_replace(host, r"^(www|m)\.", "")
    rows = pages.select(
        "page_id",
        page_text(F.col("html")).alias("text"),
        F.expr(r"nullif(lower(regexp_extract(html, '(?i)<html[^>]*\\blang\\s*=\\s*[\"\']?([a-z]{2})', 1)), '')").alias("declared"),
        F.when(host != "", host).alias("host"),
    )
    rows = rows.withColumn("suffix", F.element_at(F.split("host", r"\."), -1))
    model = train(rows, declared="declared")
    out = identify(rows, model, declared=F.col("declared"), suffix=F.col("suffix"), host=F.col("host"))
    return out.select("page_id", "declared", "text_language", "language", "posterior", "accepted")


QUERIES = {"op5_bayesian_language": op5_bayesian_language, "pages_language": pages_language}
ORACLES: dict[str, str] = {}
