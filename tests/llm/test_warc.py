import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from inkwell.llm import warc
from inkwell.llm.common import scratch_path

PAGES = "page_id long, url string, html string"


def leaves(spark, rows):
    made = [(f, p, o, o + n, hashlib.sha256(h.encode()).hexdigest(), None, None, True) for f, p, o, n, h in rows]
    return spark.createDataFrame(made, warc.LEAF)


def audit(spark, a, b):
    one, other = (leaves(spark, x) if isinstance(x, list) else x for x in (a, b))
    most = max(warc.last_place(one), warc.last_place(other))
    return warc.audit(warc.tree(one, most), warc.tree(other, most))


def statuses(found):
    return {(r["file"], r["place"] if r["place"] is not None else r["b_place"], r["status"]) for r in found.collect()}


def test_written_files_are_read_back(spark):
    rows = [(i, f"http://h/{i}", f"<p>é {i}</p>" * (i % 9)) for i in range(200)] + [(7, None, None), (None, "http://x/\r\ny", "WARC/1.1\r\nContent-Length: 5\r\n\r\n\0\0"), (300, "u", "x" * 100_000)]
    path = scratch_path(spark, "test-warc")
    df = spark.createDataFrame([(*r, "more") for r in rows], PAGES + ", replica string")
    warc.write(df, path, file_bytes=20_000)
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows) and all(r["readable"] for r in got)
    assert len({r["file"] for r in got}) > 4
    by_file = {}
    for r in got:
        by_file.setdefault(r["file"], []).append(r)
    pages = []
    raw = {int(r["path"].split("file=")[1].split("/")[0]): bytes(r["content"]) for r in spark.read.format("binaryFile").load(path + "/replica=a/file=*").select("path", "content").collect()}
    for file, part in by_file.items():
        part.sort(key=lambda r: r["place"])
        assert part[0]["start"] == 0 and all(a["end"] == b["start"] for a, b in zip(part, part[1:], strict=False)) and part[-1]["end"] == len(raw[file])
        whole = b""
        for x in part:
            own = raw[file][x["start"] : x["end"]]
            assert hashlib.sha256(own).hexdigest() == x["hash"]
            content = gzip.decompress(own)
            assert content.startswith(b"WARC/1.1\r\n") and content.endswith(b"\r\n\r\n")
            assert f"Content-Length: {len(content.split(b'\r\n\r\n', 1)[1]) - 4}\r\n".encode() in content
            whole += content
            pages.append(content.split(b"\r\n\r\n", 2)[2][:-4])
        # usual tools read such a file as one
        assert gzip.decompress(raw[file]) == whole
    assert sorted(pages) == sorted((h or "").encode() for _, _, h in rows)


def test_damage_stays_in_its_member():
    rng = random.Random(5)
    members = [warc.member(b"WARC/1.1\r\n\r\n" + rng.randbytes(n) + warc.END) for n in (50, 3000, 0, 70_000, 400)]
    members[3] += gzip.compress(b"", mtime=0)
    data = b"".join(members)
    starts = [sum(map(len, members[:i])) for i in range(5)]
    assert [s for s, _, _ in warc.records(data)] == starts
    for k in range(5):
        for at in range(0, len(members[k]), max(1, len(members[k]) // 25)):
            hurt = bytearray(data)
            hurt[starts[k] + at] ^= 1 << rng.randrange(8)
            got = warc.records(bytes(hurt))
            assert [c for i, (s, _, c) in enumerate(got) if s != starts[k] and c is not None][: 4] == [c for i, (_, _, c) in enumerate(warc.records(data)) if i != k]
            assert got[0][0] == 0 and got[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
    for cut in (1, 9, 200, len(members[4]) + 25):
        got = warc.records(data[:-cut])
        assert got[-1][2] is None and [s for s, _, _ in got] == [s for s in starts if s < len(data) - cut]
    assert warc.records(b"") == [] and warc.records(b"junk") == [(0, 4, None)]


def test_large_records_end_in_zero():
    big = warc.member(bytes(17 << 20))
    assert big[-1] == 0 and len(gzip.decompress(big)) == 17 << 20
    assert [(s, e, len(c)) for s, e, c in warc.records(big + warc.member(b"WARC/1.1"))] == [(0, len(big), 17 << 20), (len(big), len(big) + len(warc.member(b"WARC/1.1")), 8)]


def test_audit_finds_exactly_the_differences(spark):
    a = [(f, p, p * 10, 10, f"{f}-{p}") for f in range(5) for p in range(40 if f else 700)]
    b = [x if (x[0], x[1]) not in {(0, 3), (0, 699), (2, 0)} else (*x[:4], "bad") for x in a if not (x[0] == 3 and x[1] >= 38) and x[0] != 4] + [(1, 40, 400, 10, "new"), (9, 0, 0, 10, "file")]
    want = {(0, 3, "damaged"), (0, 699, "damaged"), (2, 0, "damaged"), (3, 38, "missing"), (3, 39, "missing"), (1, 40, "extra"), (9, 0, "extra")}
    want |= {(4, p, "missing") for p in range(40)}
    assert statuses(audit(spark, a, b)) == want
    assert audit(spark, a, a[::-1]).count() == 0
    assert audit(spark, [], []).count() == 0
    assert statuses(audit(spark, a[-3:], [])) == {(4, p, "missing") for p in (37, 38, 39)}


def test_lost_and_added_records_move_the_rest(spark):
    a = [(0, p, p * 10, 10, f"r{p}") for p in range(50)]
    lost = [(0, p - (p > 20), p * 10 - 10 * (p > 20), 10, f"r{p}") for p in range(50) if p != 20]
    assert statuses(audit(spark, a, lost)) == {(0, 20, "missing")} | {(0, p, "moved") for p in range(21, 50)}
    assert statuses(audit(spark, lost, a)) == {(0, 20, "extra")} | {(0, p, "moved") for p in range(20, 49)}
    # offsets alone count: the same records, but shifted, are another replica
    shifted = [(f, p, o + 1, n, h) for f, p, o, n, h in a]
    assert statuses(audit(spark, a, shifted)) == {(0, p, "moved") for p in range(50)}


def test_roots(spark):
    a = [(f, p, p * 10, 10, f"{f}-{p}") for f in range(20) for p in range(3)]
    same = warc.root(warc.tree(leaves(spark, a)))
    assert same == warc.root(warc.tree(leaves(spark, a[::-1]))) and len(same) == 64
    for changed in ([(*x[:4], "z") if x[:2] == (17, 2) else x for x in a], [(*x[:3], 11, x[4]) if x[:2] == (17, 2) else x for x in a], a[:-1]):
        assert warc.root(warc.tree(leaves(spark, changed))) != same
    assert warc.root(warc.tree(leaves(spark, []))) == hashlib.sha256(b"").hexdigest()


def test_equal_roots_end_the_audit(spark, monkeypatch):
    a = [(f, p, p * 10, 10, f"{f}-{p}") for f in range(3) for p in range(30)]
    monkeypatch.setattr(warc, "_unlike", lambda *x: pytest.fail("a branch was looked at"))
    assert audit(spark, a, a).count() == 0


def test_nodes_cover_offset_ranges(spark):
    levels = warc.tree(leaves(spark, [(0, p, p * 10, 10, str(p)) for p in range(100)]))
    assert [x.count() for x in levels] == [100, 7, 1]
    assert [(r["start"], r["end"]) for r in levels[1].orderBy("place").collect()][:2] == [(0, 160), (160, 320)]
    assert tuple(levels[2].select("start", "end").first()) == (0, 1000)


def test_lost_file(spark):
    rows = [(i, f"http://h/{i}", f"<p>page {i}</p>") for i in range(300)]
    path = scratch_path(spark, "test-lost")
    warc.write(spark.createDataFrame(rows, PAGES), path, file_bytes=20_000, replicas={"a": None, "b": None})
    one, other = (warc.read(spark, path, x) for x in "ab")
    assert audit(spark, one, other).count() == 0
    gone = one.select("file").first()[0]
    assert {r["status"] for r in audit(spark, one, other.where(F.col("file") != gone)).collect()} == {"missing"}
    assert audit(spark, one, other.where(F.col("file") != gone)).count() == one.where(F.col("file") == gone).count()


def test_query(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>page {i} with enough text</p>") for i in range(3000)] + [(None, None, None)]
    df = spark.createDataFrame(rows, PAGES)
    df.write.parquet(f"{tmp_path}/pages.parquet")
    out = warc.op6_merkle_audit(spark, str(tmp_path)).collect()
    kind = {r[0]: r[1] % 997 for r in df.select("page_id", F.expr("pmod(xxhash64('damage', page_id), 1 << 30)")).collect()}
    by = {r["page_id"]: r for r in out if r["status"] != "extra"}
    assert len(by) == len(rows) and {k for k in kind.values() if k in (1, 2, 3, 4)}
    assert {k for k, r in by.items() if r["status"] == "damaged"} == {k for k, v in kind.items() if v in (1, 2)}
    assert {k for k, r in by.items() if r["status"] == "missing"} == {k for k, v in kind.items() if v == 3}
    assert sum(r["status"] == "extra" for r in out) == sum(v == 4 for v in kind.values())
    assert all((r["record_sha256"] == r["replica_sha256"]) == (r["status"] in ("intact", "moved")) for r in out)
    spark.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert warc.op6_merkle_audit(spark, f"{tmp_path}/none").count() == 0
