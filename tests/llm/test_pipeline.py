import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from inkwell.llm import bpe

from test_language import WORDS
from test_simhash import plain_components, plain_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    rows = []
    for i in range(160):
        code = rng.choice(["en", "en", "fr", "de"])
        own = [w + s for w in WORDS[code] for s in ("", "a", "en", "t")]
        rows.append([i, " ".join(rng.choices(own, k=rng.randrange(40, 120))).capitalize() + ".", code, f"s{i % 4}"])
    junk = {i for i in range(160) if i % 9 == 4}
    for i in junk:
        rows[i][1] = rows[i][1].replace(" ", "### ") if i % 2 else rows[i][1].upper().replace(" ", "!! ")
    copies = {200 + k: 3 * k for k in range(12) if 3 * k not in junk}
    rows += [[new, rows[old][1], rows[old][2], "s9"] for new, old in copies.items()]
    rows += [[300, "12 34 56", "en", "s1"], [301, None, "en", "s1"], [302, "", None, None], [303, "жжж щщщ ыыы " * 20, "en", "s2"]]
    rows += [[None, " ".join(rng.choices(WORDS["en"], k=60)).capitalize() + ".", "en", "s0"]]
    path = str(tmp_path_factory.mktemp("corpus"))
    full = [(*r, len(r[1] or "")) for r in rows]
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i not in junk), 0) for i in range(160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, junk, copies


def test_stages(spark, corpus, tmp_path):
    path, rows, junk, copies = corpus
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for n, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        if n < len(cp.STAGES) - 1:
            assert tuple(docs.columns) == cp.COLUMNS
        kept.append({r["doc_id"]: r for r in docs.collect()})
    clean = {r[0] for r in rows if r[0] not in junk and r[0] not in (300, 301, 302, 303)}
    assert set(kept[0]) == clean | junk
    assert set(kept[1]) == clean
    # one of each group, by the definition
    texts = {k: r["text"] for k, r in kept[1].items()}
    fps = {k: plain_fingerprint(t) for k, t in texts.items()}
    root, least = plain_components(set(fps.values())), {}
    for k in texts:
        if k is not None:
            least[root[fps[k]]] = min(k, least.get(root[fps[k]], k))
    assert set(kept[2]) == set(least.values()) | {None}
    assert not set(copies) & set(kept[2])
    assert set(kept[3]) <= set(kept[2]) and len(kept[3]) > 0.7 * len(kept[2])
    plain = Tokenizer.from_file(bpe.default_path())
    assert set(kept[4]) == set(kept[3])
    for k, r in kept[4].items():
        want = plain.encode(kept[3][k]["text"], add_special_tokens=False).ids
        assert list(r["token_ids"]) == want and r["n_tokens"] == len(want)


def test_repeated_ids_and_none(spark, corpus):
    """Unlike texts of one id both stay, copies without an id do not, and mixing thins documents without ids too."""
    path, rows, junk, _ = corpus
    text = {r[0]: r[1] for r in rows}
    some = [(1, text[0], "en", "a", 1), (1, text[2], "en", "a", 1), (1, text[0], "de", "b", 1), (None, text[3], "en", "a", 1), (None, text[3], "en", None, None), (None, text[2], None, None, None), (7, None, None, None, None), (8, "", None, None, None)]
    df = spark.createDataFrame(some, SCHEMA).withColumn("extra", F.lit("x"))
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in cp.near_duplicates(spark, df, path).collect()))
    assert got == sorted([(1, text[0]), (1, text[2]), (0, text[3]), (7, "")])
    many = spark.createDataFrame([(*r, 1) for r in rows[:160]] + [(None, f"{rows[i % 160][1]} {i}", rows[i % 160][2], None, None) for i in range(600)], SCHEMA)
    kept = cp.mix(spark, many, path)
    assert tuple(kept.columns) == cp.COLUMNS and 300 < kept.where("doc_id is null").count() < 600


def test_run_and_registry(spark, corpus):
    path, *_ = corpus
    assert cp.run(spark, path).count() > 50
    assert [n for n, _ in cp.STAGES] == ["language_id", "quality_classifier", "near_duplicates", "mix", "tokenize"] and cp.ORACLE_SQL is None


def test_empty_documents(spark, corpus, tmp_path):
    path, *_ = corpus
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
