import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkwell.llm import tokenstore as ts


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_pieces_encode_as_the_whole_text(plain):
    rng = random.Random(3)
    pools = ["ab c", " \n\t", "é è ", "1 2'", "<|endoftext|>", "\x1c\x1d \x85", "​ 　", "don't we'll ", "!!  ??"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(60))) for _ in range(4000)] + ["", " ", "a", " a", "a ", "<|endoftext|> x"]
    for text, ids in zip(texts, ts.Encoder(public_tokenizers.path("byte_bpe_50k.json")).encode(texts), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_cuts_follow_content():
    rng = np.random.default_rng(0)
    passage = rng.integers(0, 50_000, 6000)
    a = np.concatenate([rng.integers(0, 50_000, 777), passage])
    b = np.concatenate([rng.integers(0, 50_000, 1333), passage])
    cuts = lambda x: ts.cut_points(len(x), ts.marks(x))
    chunks = lambda x: {x[s:e].tobytes() for s, e in zip([0, *cuts(x)], cuts(x), strict=False)}
    assert len(chunks(a) & chunks(b)) >= 10
    for x in (a, b, a[:10], a[:0], np.zeros(5000, dtype=np.int64)):
        ends = cuts(x)
        assert sum(np.diff([0, *ends])) == len(x) and all(d <= ts.MOST for d in np.diff([0, *ends]))


def test_cuts_do_not_depend_on_what_stands_before():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 60_000 + 40_000 * (i % 2), n) for i, n in enumerate((5, 900, 64, 0, 3000, 65, 4097))]
    stream, first = np.concatenate(texts), 0
    for x in texts:
        assert ts.cut_points(len(x), ts.marks(stream), first) == ts.cut_points(len(x), ts.marks(x))
        first += len(x)


def test_crc_of_joined_parts():
    for a, b in ((b"", b""), (b"abc", b""), (b"", b"abc"), (b"one", b"two" * 1000), (bytes(5000), b"\xff")):
        assert ts.crc_append(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_round_trip_and_digests(spark, docs, plain):
    words = ["alpha", "beta,", "gamma", "é", "\n", "12"]
    rng = random.Random(1)
    shared = " ".join(rng.choices(words, k=900))
    rows = [(7, shared + " x"), (3, shared), (5, None), (4, ""), (9, shared), (9, shared), (9, "other"), (None, "no id"), (None, "no id"), (12, "w " * 20000)]
    path = ts.scratch_path(spark, "test-store")
    ts.write(docs(rows), path)
    start = 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in ts.checksums(spark, path).collect()), key=lambda r: r[1])
    whole = {r["start"]: list(r["token_ids"]) for r in ts.reconstruct(spark, path).collect()}
    assert [g[0] for g in got] == [r[0] for r in ordered]
    by_id = {}
    for k, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        by_id.setdefault(k, []).append((len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), ids))
    for k, s, n, crc in got:
        assert s == start
        assert (n, crc, whole[s]) in by_id[k]
        start += n
    objects = ts.objects(spark, path)
    assert objects.count() == objects.select("address").distinct().count()
    rows_in_manifest = spark.read.parquet(f"{path}/manifest").agg({"rows": "sum"}).first()[0]
    assert rows_in_manifest == len(rows)


def rewritten(spark, path, name, change):
    """The store's table ``name`` after ``change``, in its place."""
    df = change(spark.read.parquet(f"{path}/{name}")).cache()
    df.count()
    df.write.mode("overwrite").parquet(f"{path}/{name}")
    df.unpersist()


@pytest.mark.parametrize(
    "name, change, says",
    [
        ("recipes", lambda d: d.where("key <> 2"), "do not fit the manifest"),
        ("recipes", lambda d: d.withColumn("addresses", F.reverse("addresses")), "does not fit its root"),
        ("recipes", lambda d: d.withColumn("root", F.when(F.col("key") == 3, F.lit(b"another")).otherwise(F.col("root"))), "do not fit the manifest"),
        ("manifest", lambda d: d.where("block <> 0"), "does not fit its head"),
        ("manifest", lambda d: d.withColumn("tokens", F.col("tokens") + 1), "does not fit its head"),
    ],
)
def test_altered_recipes_and_manifests_are_found(spark, docs, monkeypatch, name, change, says):
    monkeypatch.setattr(ts, "MANIFEST_ROWS", 4)
    path = ts.scratch_path(spark, "test-altered")
    ts.write(docs([(i, f"some words {i} and " + "more " * 2500) for i in range(9)]), path)
    rewritten(spark, path, name, change)
    with pytest.raises(Exception, match=says):
        (ts.checksums if name == "recipes" else ts.reconstruct)(spark, path).collect()


def test_lost_objects_are_found(spark, docs):
    path = ts.scratch_path(spark, "test-lost")
    ts.write(docs([(1, "some words here"), (2, "others")]), path)
    kept = ts.objects(spark, path).orderBy("address").limit(1).cache()
    kept.count()
    rewritten(spark, path, "parts", lambda d: d.where("kind = 'objects'").join(kept.select("address"), "address", "left_semi"))
    for reader in (ts.checksums, ts.reconstruct):
        with pytest.raises(Exception, match="is lost"):
            reader(spark, path).collect()


def test_files_are_in_ascending_order(spark, docs, monkeypatch):
    monkeypatch.setattr(ts, "MANIFEST_ROWS", 64)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    for coalesce in ("false", "true"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        path = ts.scratch_path(spark, "test-order")
        rows = [(i * 7919 % 1000, f"text {i} " * (i % 5)) for i in range(1000)] + [(77, "the same")] * 300
        ts.write(docs(rows), path)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
        read = spark.read.parquet(f"{path}/recipes").withColumn("f", F.input_file_name()).select("f", "block", "place", "key").collect()
        files = {}
        for r in read:
            files.setdefault(r["f"].rsplit("/", 1)[1], []).append((r["block"], r["place"], r["key"]))
        assert all(part == sorted(part) for part in files.values())
        in_order = [x for name in sorted(files) for x in files[name]]
        assert [k for *_, k in in_order] == sorted(k for k, _ in rows)
        assert in_order == sorted(in_order)
        if coalesce == "false":
            assert len(files) > 10 and len({b for b, *_ in in_order}) == len(files)
        got = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in ts.checksums(spark, path).collect())
        assert [s for s, *_ in got] == [sum(n for _, n, _ in got[:i]) for i in range(len(got))]
        assert [k for *_, k in got] == sorted(k for k, _ in rows)


def test_key_named_like_a_result(spark):
    path = ts.scratch_path(spark, "test-names")
    df = spark.createDataFrame([(5, "a b", 1), (4, "c" * 70_000, 2)], "start long, text string, block int")
    ts.write(df, path, key="start")
    assert [r["key"] for r in ts.checksums(spark, path, key="start").orderBy("start").collect()] == [4, 5]
    assert ts.reconstruct(spark, path, key="start").columns == ["key", "start", "n_tokens", "token_ids"]


def test_no_end_id(spark, docs):
    path = ts.scratch_path(spark, "test-noend")
    ts.write(docs([(1, ""), (2, "a b"), (3, None)]), path, end_id=None)
    got = {r["doc_id"]: (r["start"], r["n_tokens"]) for r in ts.checksums(spark, path).collect()}
    assert got == {1: (0, 0), 2: (0, 2), 3: (2, 0)}
    assert {r["doc_id"]: len(r["token_ids"]) for r in ts.reconstruct(spark, path).collect()} == {1: 0, 2: 2, 3: 0}


def test_damage_is_found(spark, docs):
    path = ts.scratch_path(spark, "test-damage")
    ts.write(docs([(1, "some words here"), (2, "others")]), path)
    bad = ts.objects(spark, path).selectExpr("address", "n", "cast('xx' as binary) payload", "'objects' kind")
    bad.write.mode("append").partitionBy("kind").parquet(f"{path}/parts")
    with pytest.raises(Exception, match="damaged"):
        ts.checksums(spark, path).collect()


def test_empty_table(spark, docs):
    path = ts.scratch_path(spark, "test-empty")
    ts.write(docs([]), path)
    assert ts.checksums(spark, path).count() == 0


def test_sums_of_many_chunks_join_at_once():
    """Documents' sums from their chunks' sums, by columns: no step for each chunk in Python."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(12)
    rows, want = [], []
    for place in range(60):
        chunks = [bytes(rng.randrange(256) for _ in range(4 * rng.choice([1, 64, 300, 1024]))) for _ in range(rng.choice([1, 2, 9]))]
        n = sum(map(len, chunks)) // 4
        rows += [(0, place, pos, place, 7, n, len(c) // 4, zlib.crc32(c)) for pos, c in enumerate(chunks)]
        want.append((place, 7, n, zlib.crc32(b"".join(chunks))))
    names = ["block", "place", "pos", "key", "start", "n_tokens", "len", "crc"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
    assert [tuple(r.values()) for r in ts._joined(batch).to_pylist()] == want
    big = np.array([1 << 20, (1 << 22) + 4, 0])
    assert ts.crcs_shifted(np.array([5, 0xFFFFFFFF, 9]), big).tolist() == [ts.crc_append(c, 0, int(n)) for c, n in zip((5, 0xFFFFFFFF, 9), big, strict=True)]
