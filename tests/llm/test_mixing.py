import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import mixing


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    own = {d: [f"{d}{k}" for k in range(30)] for d in ("de", "en", "fr")}
    rows = []
    for i in range(n):
        d = rng.choices(["de", "en", "fr"], weights=[2, 6, 1])[0]
        mix = own[d] + (own["en"] if rng.random() < 0.3 else [])
        rows.append((i, " ".join(rng.choices(mix, k=rng.randrange(5, 80))), d, "s", 0))
    return rows


def labels(spark, ids):
    return spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int")


def test_posteriors_match_brute_force(spark, docs):
    rows = corpus()
    df = docs(rows + [(900, None, "en", None, 0), (901, "", None, None, 0), (901, "", None, None, 0), (None, "de1 fr2", None, None, 0)])
    sample = mixing.labelled_sample(df, labels(spark, range(0, 300, 2)), "lang")
    classifier = mixing.fit_classifier(sample)
    names, model, priors = classifier
    w = {r["slot"]: [r[f"w{i}"] for i in range(len(names))] for r in model.collect()}
    slot = {r[0]: r[1] for r in df.select(F.explode(F.split("text", " ")).alias("x")).distinct().select("x", mixing._slot(F.col("x"))).collect()}
    texts = {}
    for r in df.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    got = mixing.posteriors(df, classifier).collect()
    assert len(got) == len(rows) + 4
    for r in got:
        words = texts[r["doc_id"]][0].split()
        assert r["n_tokens"] == len(words)
        soft = min(1.0, mixing.EVIDENCE / max(len(words), 1))
        log = [priors[i] + soft * sum(w[slot[x]][i] for x in words) for i in range(len(names))]
        e = np.exp(np.array(log) - max(log))
        assert np.allclose(list(r["p"]), e / e.sum(), atol=1e-9)


def test_rates_reach_targets_and_stay_nonnegative(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3, 0.3, 0.3], size=400)
    n = rng.integers(1, 500, size=400)
    frame = spark.createDataFrame([(int(i), int(k), [float(v) for v in q]) for i, (k, q) in enumerate(zip(n, p, strict=True))], "rid long, n_tokens long, p array<double>")
    totals = (n[:, None] * p).sum(axis=0)
    for targets, most in ((totals * [1.0, 0.5, 2.0], None), (totals * [0.05, 1.5, 1.0], None), (totals * [0.9, 0.7, 0.8], 1.0)):
        rate, _, _ = mixing.fit_rates(frame, 3, targets.tolist(), most)
        got = np.array([r[0] for r in frame.orderBy("rid").select(rate).collect()])
        assert got.min() >= 0 and (most is None or got.max() <= most)
        assert np.allclose((n[:, None] * p * got[:, None]).sum(axis=0), targets, rtol=2e-3)


def test_natural_targets():
    t = mixing.natural_targets([600.0, 300.0, 100.0, 0.0])
    assert t[3] == 0 and math.isclose(t[2], 100.0) and t[0] < 600 and t[0] / t[1] < 2
    assert mixing.natural_targets([0.0, 0.0]) == [0.0, 0.0]


def test_copies_follow_rates(spark):
    df = spark.range(20_000).select(mixing.copies(F.lit(1.3), F.col("id")).alias("a"), mixing.copies(F.lit(0.0), F.col("id")).alias("b"), mixing.copies(F.lit(2.0), F.col("id")).alias("c"))
    a, b, c = df.agg(F.avg("a"), F.max("b"), F.min("c")).first()
    assert abs(a - 1.3) < 0.02 and b == 0 and c == 2


def test_query_and_edges(spark, docs, tmp_path):
    rows = corpus(120)
    for name, data, ids in (("a", rows, range(0, 120, 3)), ("b", [], []), ("c", [(1, "x y", None, None, 0)], [])):
        docs(data).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels(spark, ids).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = mixing.op9_soft_mixing(spark, f"{tmp_path}/{name}").collect()
        assert len(out) == len(data) and all(r["rate"] >= 0 and r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1) for r in out)
    plan = mixing.op9_soft_mixing(spark, f"{tmp_path}/a")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_every_domain_is_fitted(spark, docs):
    rng = random.Random(6)
    # 20 sources, the last one rare: 3 of about 5000 labelled rows
    rows = [(i, " ".join(f"s{i % 19}w{rng.randrange(9)}" for _ in range(20)), "en", f"s{i % 19}", 0) for i in range(5000)]
    rows += [(9000 + i, " ".join(f"rare{rng.randrange(9)}" for _ in range(20)), "en", "rare", 0) for i in range(3)]
    known = labels(spark, [r[0] for r in rows])
    sample = mixing.labelled_sample(docs(rows), known, "source", rows=100)
    sizes = {r["domain"]: (r["n"], r["of"]) for r in sample.groupBy("domain").agg(F.count("of").alias("n"), F.max("of").alias("of")).collect()}
    assert len(sizes) == 20 and sizes["rare"] == (3, 3) and all(50 < n < 160 for d, (n, _) in sizes.items() if d != "rare")
    targets = {f"s{k}": 4000.0 for k in range(19)} | {"rare": 180.0}
    got = mixing.rates(docs(rows), known, "source", targets=targets).collect()
    assert len(got[0]["domains"]) == 20
    at = got[0]["domains"].index("rare")
    assert math.isclose(sum(r["rate"] * r["n_tokens"] * r["p"][at] for r in got), 180.0, rel_tol=0.02)
    with pytest.raises(ValueError, match="nowhere"):
        mixing.rates(docs(rows), known, "source", targets={"nowhere": 1.0})
