import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from inkwell.llm import minhash as mh


def chained(*parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p, h)
    return h





def plain_hashes(text):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w]
    n = max(1, len(words) - mh.WORDS + 1) if words else 0
    return [chained(*[w.encode() for w in words[i : i + mh.WORDS]]) >> 1 for i in range(n)]


def plain_fingerprint(text, of):
    hs = plain_hashes(text)
    if not hs:
        return []
    least = {}
    for h in hs:
        b = h >> mh._HIGH
        least[b] = min(h, least.get(b, h))
    out = []
    for j in range(mh.BINS):
        v = least.get(j)
        for a in range(mh.ATTEMPTS):
            v = least.get(of[j, a] % mh.BINS) if v is None else v
        if v is None:
            v = min((of[j, b, -1], least[b]) for b in least)[1]
        out.append((v & 255) - 128)
    return out


@pytest.fixture(scope="module")
def of(spark):
    ids = spark.range(mh.BINS).select(F.col("id").cast("int").alias("j"))
    found = {}
    for a in range(mh.ATTEMPTS):
        found.update({(r[0], a): r[1] for r in ids.select("j", F.xxhash64("j", F.lit(a))).collect()})
    pairs = ids.crossJoin(ids.withColumnRenamed("j", "b")).select("j", "b", F.xxhash64("j", F.col("b").cast("long"), F.lit(-1)).alias("h"))
    found.update({(r[0], r[1], -1): r[2] for r in pairs.collect()})
    return found


def texts():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randrange(1, 7))) for _ in range(400)]
    sizes = [0, 1, 2, 4, 5, 6, 9, 15, 40, 90, 200, 600, 5000]
    return [None, "", " \n\t ", *(" ".join(rng.choices(vocabulary, k=k)) for k in sizes), "tab\tnew\nline  two spaces end "]


def test_fingerprint_matches_brute_force(spark, docs, of):
    rows = docs(list(enumerate(texts()))).select("text", mh.fingerprint(F.col("text")).alias("fp")).collect()
    for r in rows:
        assert list(r["fp"]) == plain_fingerprint(r["text"], of), (r["text"] or "")[:40]


def test_likeness_follows_jaccard(spark, docs):
    rng = random.Random(4)
    rows, truth = [], {}
    for i, share in enumerate([0.0, 0.2, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0] * 6):
        size = rng.choice([60, 300, 1500])
        a = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        keep = int(share * size)
        b = a[:keep] + [f"v{rng.randrange(10**6)}" for _ in range(size - keep)]
        sets = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (a, b)]
        truth[i] = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        rows.append((i, " ".join(a), " ".join(b)))
    got = spark.createDataFrame(rows, "i int, a string, b string").select("i", mh.likeness(mh.fingerprint(F.col("a")), mh.fingerprint(F.col("b"))).alias("x")).collect()
    errors = [r["x"] - truth[r["i"]] for r in got]
    assert max(map(abs, errors)) < 0.15 and abs(sum(errors)) / len(errors) < 0.03
    assert all(r["x"] == 1.0 for r in got if truth[r["i"]] == 1.0)


@pytest.mark.parametrize("range_rows", [3, 1000])
def test_next_row_and_edit(spark, docs, tmp_path, range_rows):
    rng = random.Random(8)
    ids = rng.sample(range(1000), 40)
    rows = [(i, "".join(rng.choices("aé中😀 \n", k=rng.randrange(30)))) for i in ids] + [(2000, None), (-5, "last one")]
    out = mh.with_next(docs(rows).select("doc_id", "text"), "doc_id", "text", ["doc_id", "text"], range_rows).collect()
    ordered = sorted(rows, key=lambda r: -r[0])
    follows = {a[0]: b for a, b in zip(ordered, ordered[1:] + ordered[:1], strict=True)}
    assert {r["doc_id"]: (r["next_doc_id"], r["next_text"]) for r in out} == follows and len(out) == len(rows)
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    for r in mh.op4_one_permutation_minhash(spark, str(tmp_path)).collect():
        text, after = dict(rows)[r["doc_id"]] or "", follows[r["doc_id"]][1] or ""
        k = len(text) // 3
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest()


def test_empty_and_odd_tables(spark, docs, tmp_path):
    for n, rows in enumerate(([], [(1, "alone here")], [(None, "a"), (None, "b"), (3, "c"), (3, "c"), (3, "d")])):
        docs(rows).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        out = mh.op4_one_permutation_minhash(spark, f"{tmp_path}/{n}").collect()
        assert len(out) == len(rows)
        assert all(r["near_edited"] is not None and 0 <= r["near_next"] <= 1 for r in out)


def test_ranges_share_the_rows(spark, docs):
    rows = docs([(i * 7 - 900, "x") for i in range(3000)] + [(None, "y")])
    sizes = [r[1] for r in mh.in_ranges(rows, "doc_id", 100).groupBy("range").count().orderBy("range").collect()]
    assert len(sizes) == 32 and max(sizes) < 200 and sizes[-1] == 1
    got = mh.in_ranges(rows, "doc_id", 100).groupBy("range").agg(F.max("doc_id").alias("a"), F.min("doc_id").alias("b")).orderBy("range").collect()
    assert all(x["b"] > y["a"] for x, y in zip(got, got[1:-1], strict=False))
