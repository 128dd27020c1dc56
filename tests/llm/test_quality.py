import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from inkwell.llm import quality as q


def sample(n=240, seed=3):
    rng = random.Random(seed)
    words = ["the", "of", "river", "stone", "under", "walked", "morning", "quiet"]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choices(words, k=rng.randrange(20, 200))).capitalize() + "."
        good = rng.random() < 0.7
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", "### "), " ".join(f"{w} {w} {w} {w}" for w in text.split()), text.replace(" ", " | ")])
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark, docs, tmp_path):
    rows, labels = sample()
    docs(rows + [(900, None), (901, ""), (None, "x")]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r["doc_id"]: r for r in q.op10_bradley_terry(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows) + 3
    truth = {i: y for i, y, _ in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i]["held_out"] == (i in set(held)) for i in truth)
    assert sum(out[i]["predicted"] == truth[i] for i in held) / len(held) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    assert out[900]["score"] == out[901]["score"]


def test_fit_prefers_and_cuts_at_the_quantile():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    y = (x @ [1.0, -2.0, 0.0, 0.5] + rng.normal(scale=0.3, size=500) > -1).astype(int)
    r = q.fit(x, y, pairs=20_000)
    s = r.score(x)
    assert np.mean(s[y == 1][:, None] > s[y == 0][None, :]) > 0.97
    assert abs(np.mean(s < q.CUT) - np.mean(y == 0)) < 0.01
    assert q.fit(x, y, pairs=20_000).threshold == r.threshold


def test_one_class_or_none_gives_one_half():
    for y in (np.ones(5), np.zeros(5)):
        assert np.allclose(q.fit(np.random.default_rng(0).normal(size=(5, len(q.FEATURES))), y).score(np.zeros((2, len(q.FEATURES)))), 0.5)
    assert np.allclose(q.fit(np.zeros((0, len(q.FEATURES))), np.zeros(0)).score(np.ones((1, len(q.FEATURES)))), 0.5)


def test_labels_missing_or_repeated(spark, docs):
    df = docs([(1, "a b c"), (1, "a b c"), (2, "D!! E!!")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = q.scored(df, q.train(df, none)).select("score").distinct().collect()
    assert [r[0] for r in got] == [0.5]
    odd = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (7, None), (3, 5)], "doc_id long, quality int")
    assert q.scored(df, q.train(df, odd)).count() == 3
    assert q.scored(docs([]), q.train(df, odd)).count() == 0


def test_fold_rule(spark):
    got = spark.range(200).select("id", q.held_out("id").alias("h"), F.lit(1)).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)
