import zlib

import pytest
from pyspark.sql import functions as F

from inkwell.llm import sharding
from inkwell.llm.common import scratch_path


def test_shards_slots_and_records(spark, docs, tmp_path):
    rows = [(i, f"text {i} é" * (i % 7)) for i in range(1000)] + [(None, "x")] * 300 + [(5, "text 5 é" * 5)] * 3 + [(2000, None), (2001, "long " * 50_000)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.op7_two_pass_shuffle(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == sorted((str(k), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in rows)
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(s) for s in by.values()]
    assert max(sizes) - min(sizes) <= 1


def test_order_is_seeded_and_mixed(spark, docs):
    df = docs([(i, str(i)) for i in range(3000)])

    def order(seed, bucket_bytes=4000):
        out = sharding.external_shuffle(df, scratch_path(spark, "test-shards"), shards=4, seed=seed, bucket_bytes=bucket_bytes)
        return [r[0] for r in out.orderBy("shard", "slot").select("record.doc_id").collect()]

    a, b, c = order(1), order(1), order(2)
    assert a == b != c and sorted(a) == sorted(c) == list(range(3000))
    # far from sorted: neighbours are as far apart as in a random order, and halves mix
    gaps = [abs(x - y) for x, y in zip(a, a[1:], strict=False)]
    assert 850 < sum(gaps) / len(gaps) < 1150
    assert 650 < sum(x < 1500 for x in a[:1500]) < 850
    one = order(1, bucket_bytes=1 << 30)
    assert sorted(one) == sorted(a) and one != a


@pytest.mark.parametrize("rows", [[], [(1, "only")]])
def test_small_tables(spark, docs, rows):
    out = sharding.external_shuffle(docs(rows), scratch_path(spark, "test-shards"))
    assert [(r["record"]["doc_id"], r["shard"], r["slot"]) for r in out.collect()] == [(k, 0, 0) for k, _ in rows]


def test_extra_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a", 9, 8), (2, "b", 7, 6)], "doc_id long, text string, shard int, bucket int")
    out = sharding.external_shuffle(df, scratch_path(spark, "test-shards"), shards=2)
    assert sorted(out.select("record.shard", "record.bucket").collect()) == [(7, 6), (9, 8)]


def test_rows_of_one_key_share_no_bucket(spark, docs):
    """A hot key's records are spread like any others; every record arrives once."""
    rows = [(1, "the same words")] * 10_000 + [(k, f"text {k}") for k in range(2, 1500)]
    df = docs(rows).repartition(5).cache()
    out = sharding.external_shuffle(df, scratch_path(spark, "test-hot"), shards=10, bucket_bytes=10_000)
    files = out.select("record.doc_id", F.input_file_name().alias("f")).groupBy("f").agg(F.count("*").alias("n")).collect()
    assert len(files) >= 20 and max(r["n"] for r in files) < 2000
    got = out.select("record.doc_id", "record.text", "shard", "slot").collect()
    assert sorted((r[0], r[1]) for r in got) == sorted(rows)
    assert len({(r["shard"], r["slot"]) for r in got}) == len(rows)


def test_one_exchange_of_records(spark, docs, tmp_path):
    """The plan has no join with the records but the broadcast of heavy keys, however small broadcasts must be."""
    docs([(i, "word " * 50) for i in range(4000)]).write.parquet(f"{tmp_path}/d.parquet")
    df, old = spark.read.parquet(f"{tmp_path}/d.parquet"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        out = sharding.external_shuffle(df, scratch_path(spark, "test-plan"), bucket_bytes=50_000)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert out.count() == 4000 and out.select("shard", "slot").distinct().count() == 4000


def test_ties_in_key_and_text_follow_other_columns(spark):
    rows = [(1, "same", i) for i in range(50)]

    def order(frame):
        out = sharding.external_shuffle(frame, scratch_path(spark, "test-ties"), shards=1)
        return [r[0] for r in out.orderBy("slot").select("record.more").collect()]

    make = lambda x: spark.createDataFrame(x, "doc_id long, text string, more int").coalesce(1)
    assert order(make(rows)) == order(make(rows[::-1]))


def test_main_path_runs_no_python(spark, docs):
    out = sharding.external_shuffle(docs([(1, "a")]), scratch_path(spark, "test-shards"))
    assert "Python" not in out.select(F.col("shard"))._jdf.queryExecution().toString()
