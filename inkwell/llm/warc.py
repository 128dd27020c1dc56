"""WARC files and a Merkle fixity audit of their replicas.

A file holds records, each a gzip member of its own, so damage stays within a record. Members are found and hashed (SHA-256 of the file's
bytes) where the files are read. Hashes and offset ranges of ``FAN`` neighbours in offset order make a node that covers their range;
nodes make nodes, up to one root for each file. Files' roots meet in a tree of the replica by their names' hashes, up to one root. Two replicas are
compared from that root: if it is the same the audit ends there, else only branches that differ are looked at.

Trees are tables (``level, file, place, start, end, hash``), made by one aggregation for each level with ``FAN`` rows in a group at most (of files
with one bucket of names: ``FAN`` on average).

Findings: ``damaged`` (other bytes in its place), ``moved`` (same bytes of the same file elsewhere), ``missing`` and ``extra``. Bytes that are no
readable member (flipped, cut off) are one record of the file, up to the next member that starts with a WARC record; a lost file's records are missing.

Edge cases: null URLs and payloads are written empty; pages that repeat are records of their own; a file without records has no tree; an empty
table gives an empty audit. Columns of the pages other than the three named are not written.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch_path, table

FAN = 16
FILE_BYTES = 8 << 20
END = b"\r\n\r\n"
LEVEL = 6


def response_record(identity: Column, url: Column, payload: Column) -> Column:
    """A WARC/1.1 response record, without the two line ends that close it."""
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), F.coalesce(payload, F.lit("")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-record:"),
        F.coalesce(identity.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "),
        F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", ""),
        F.lit("\r\nWARC-Payload-Digest: sha256:"),
        F.sha2(F.coalesce(payload, F.lit("")).cast("binary"), 256),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body)


def member(record: bytes) -> bytes:
    """A gzip member that ends in a zero byte. (Its last byte is the size's highest: where that isn't zero, an empty member follows.)"""
    out = gzip.compress(record, LEVEL, mtime=0)
    return out if out[-1] == 0 else out + gzip.compress(b"", LEVEL, mtime=0)


Plant = Callable[[int, bytes], list[bytes]]


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", file_bytes: int = FILE_BYTES, replicas: dict[str, Plant | None] | None = None) -> None:
    """Write pages as WARC files ``replica=R/file=N/part-*.txt`` (gzip members one after the other).

    A file holds consecutive records of one input partition, of about ``file_bytes`` of text in all, so no page is shuffled.
    ``replicas``: names, each with what becomes of a record's member there, given a number drawn from its key (None: it stays).
    """
    replicas = replicas or {"a": None}
    n, size = pages.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.coalesce(F.col(payload), F.lit(""))) + 512)).first()
    rows = max(1, int(file_bytes / max((size or 0) / max(n, 1), 1.0)))
    at = F.monotonically_increasing_id()
    # the row's number within its partition is in the low 33 bits, the partition's above
    placed = pages.select(at.alias("at"), F.pmod(F.xxhash64(F.lit("damage"), F.col(key)), F.lit(1 << 30)).alias("draw"), response_record(F.col(key), F.col(url), F.col(payload)).alias("record"))
    file = F.shiftright("at", 33) * F.lit(1 << 24) + F.floor(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) / rows)

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                out: list[tuple] = []
                for k, f, d, r in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    own = member(r.encode() + END)
                    for name, plant in replicas.items():
                        # the writer's separator gives the last byte
                        out += [(name, f, k, i, x[:-1]) for i, x in enumerate([own] if plant is None else plant(d, own))]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                columns = zip(*out, strict=True) if out else ([],) * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["replica", "file", "at", "part", "value"])

    made = placed.select("at", file.cast("long").alias("file"), "draw", "record").mapInArrow(run, "replica string, file long, at long, part int, value binary")
    ordered = made.sortWithinPartitions("replica", "file", "at", "part").select("replica", "file", F.col("value").cast("string").alias("value"))
    # bytes as they are, each member's last one, zero, as the separator
    ordered.write.partitionBy("replica", "file").option("lineSep", "\0").text(path)


_MAGIC = b"\x1f\x8b\x08"
_FIELD = re.compile(rb"(?im)^warc-(record-id|target-uri):[ \t]*(.*?)[ \t]*\r?$")


def _unpacked(data: bytes, start: int) -> tuple[int, bytes] | None:
    """End and content of the member that starts here; None if it can't be read. Input is given up to where a next member may start."""
    stream, out, at = zlib.decompressobj(31), [], start
    try:
        while not stream.eof and at < len(data):
            end = data.find(_MAGIC, max(at, start + 1))
            end = len(data) if end < 0 else end if end > at else at + 1
            out.append(stream.decompress(data[at:end]))
            at = end
    except zlib.error:
        return None
    return (at - len(stream.unused_data), b"".join(out)) if stream.eof else None


def records(data: bytes) -> list[tuple[int, int, bytes | None]]:
    """Start, end and content of the records of one file; the content is None where bytes can't be read as a member. Empty members belong to the record before them."""
    out: list[tuple[int, int, bytes | None]] = []
    at = 0
    while at < len(data):
        found = _unpacked(data, at)
        if found and found[1] == b"" and out:
            out[-1] = (out[-1][0], found[0], out[-1][2])
        elif found:
            out.append((at, found[0], found[1]))
        else:
            end = data.find(_MAGIC, at + 1)
            while end >= 0 and not ((next_ := _unpacked(data, end)) and next_[1].startswith(b"WARC/")):
                end = data.find(_MAGIC, end + 1)
            out.append((at, end if end >= 0 else len(data), None))
        at = out[-1][1]
    return out


LEAF = "file long, place long, start long, end long, hash string, record_id string, uri string, readable boolean"


def read(spark: SparkSession, path: str, replica: str = "a") -> DataFrame:
    """One row for each record of a replica's files: file, place (its number), offset range, SHA-256 of its bytes, id and URI, whether it can be read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(f"{path}/replica={replica}")
    named = files.select(F.regexp_extract("path", r"file=(-?\d+)", 1).cast("long").alias("file"), "content")

    def run(batches):
        for batch in batches:
            for file, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, rows = body.as_py(), []
                for place, (start, end, content) in enumerate(records(data)):
                    head = (content or b"")[: max((content or b"").find(b"\r\n\r\n"), 0)]
                    fields = {k.lower(): v.decode(errors="replace") for k, v in _FIELD.findall(head)}
                    digest = hashlib.sha256(memoryview(data)[start:end]).hexdigest()
                    rows.append((file, place, start, end, digest, fields.get(b"record-id"), fields.get(b"target-uri"), content is not None))
                if rows:
                    kinds = (*(pa.int64(),) * 4, *(pa.string(),) * 3, pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split(" ")[0] for x in LEAF.split(", ")])

    return named.mapInArrow(run, LEAF)


def _hashed(kids: Column, kind: str) -> Column:
    """SHA-256 of a node's sorted children, whose last field is their hash: places, ranges and hashes all count."""
    return F.sha2(F.concat(F.lit(f"{kind}:"), F.to_json(kids)).cast("binary"), 256)


def _parents(level: DataFrame, height: int) -> DataFrame:
    kids = F.array_sort(F.collect_list(F.struct("place", "start", "end", "hash")))
    return (
        level.groupBy("file", F.expr(f"place div {FAN}").alias("place"))
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), kids.alias("kids"))
        .select(F.lit(height).alias("level"), "file", "place", "start", "end", _hashed(F.col("kids"), f"node:{height}").alias("hash"))
    )


def last_place(leaves: DataFrame) -> int:
    """The greatest record number of any file; -1 where there are none."""
    found = leaves.agg(F.max("place")).first()[0]
    return -1 if found is None else int(found)


def tree(leaves: DataFrame, most: int | None = None, label: str = "merkle") -> list[DataFrame]:
    """Levels from the records up; every file ends in one node of place 0 on the last level. Each level is a table of its own.

    ``most``: the last place that sets the height; replicas to be compared need the same."""
    level = materialise(leaves.select(F.lit(0).alias("level"), "file", "place", "start", "end", "hash"), label)
    levels, most = [level], last_place(level) if most is None else most
    while most > 0 or len(levels) == 1:
        levels.append(materialise(_parents(levels[-1], len(levels)), label))
        most //= FAN
    return levels


def replica_tree(levels: list[DataFrame], depth: int) -> list[DataFrame]:
    """Levels over the files' roots (``place, hash``), from ``FAN ** depth`` buckets of files up to the replica's root. An empty replica has no node."""
    files = levels[-1].select(F.pmod(F.xxhash64("file"), F.lit(FAN**depth)).alias("place"), "file", "start", "end", "hash")
    out = [files.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("file", "start", "end", "hash"))).alias("kids")).select("place", _hashed(F.col("kids"), "files").alias("hash"))]
    for _ in range(depth):
        above = out[-1].groupBy(F.expr(f"place div {FAN}").alias("place")).agg(F.array_sort(F.collect_list(F.struct("place", "hash"))).alias("kids"))
        out.append(above.select("place", _hashed(F.col("kids"), "above").alias("hash")))
    return [materialise(x, "merkle-replica") for x in out]


def depth_for(files: int) -> int:
    depth = 1
    while FAN ** (depth + 1) < files:
        depth += 1
    return depth


def root(levels: list[DataFrame], depth: int = 1) -> str:
    """The replica's root hash."""
    top = replica_tree(levels, depth)[-1].first()
    return top["hash"] if top else hashlib.sha256(b"").hexdigest()


FINDING = "file long, place long, a_start long, a_end long, b_place long, b_start long, b_end long, a_hash string, b_hash string, status string"


def _unlike(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    a, b = (x.select(*by, F.col("hash").alias(f"{n}_hash")) for n, x in (("a", a), ("b", b)))
    return a.join(b, by, "full").where(~F.col("a_hash").eqNullSafe(F.col("b_hash"))).select(*by)


def audit(one: list[DataFrame], other: list[DataFrame]) -> DataFrame:
    """Records that differ: file, place, both offset ranges and hashes, and ``status`` damaged, moved, missing (from ``other``) or extra. Both trees have one height."""
    spark = one[0].sparkSession
    if len(one) != len(other):
        raise ValueError("trees of one height are compared: build both with the same last place")
    depth = depth_for(max(x[-1].count() for x in (one, other)))
    a_top, b_top = replica_tree(one, depth), replica_tree(other, depth)
    a_root, b_root = a_top[-1].first(), b_top[-1].first()
    if (a_root and a_root["hash"]) == (b_root and b_root["hash"]):
        return spark.createDataFrame([], FINDING)
    suspects: DataFrame | None = None
    for a, b in zip(a_top[-2::-1], b_top[-2::-1], strict=True):
        if suspects is not None:
            a, b = (x.withColumn("up", F.expr(f"place div {FAN}")).join(suspects, "up", "left_semi") for x in (a, b))
        suspects = materialise(_unlike(a, b, ["place"]).select(F.col("place").alias("up")), "merkle-suspects")
    a, b = (x[-1].withColumn("up", F.pmod(F.xxhash64("file"), F.lit(FAN**depth))).join(suspects, "up", "left_semi") for x in (one, other))
    suspects = materialise(_unlike(a, b, ["file"]).select("file", F.lit(0).cast("long").alias("up")), "merkle-suspects")
    for k in reversed(range(1, len(one) - 1)):
        a, b = (x[k].withColumn("up", F.expr(f"place div {FAN}")).join(suspects, ["file", "up"], "left_semi") for x in (one, other))
        suspects = materialise(_unlike(a, b, ["file", "place"]).select("file", F.col("place").alias("up")), "merkle-suspects")
    a, b = (x[0].withColumn("up", F.expr(f"place div {FAN}")).join(suspects, ["file", "up"], "left_semi") for x in (one, other))
    a, b = (x.select("file", "place", F.struct("start", "end", "hash").alias(n)) for n, x in (("a", a), ("b", b)))
    differ = materialise(a.join(b, ["file", "place"], "full").where(~F.col("a").eqNullSafe(F.col("b"))), "merkle-differ")
    return _findings(differ)


def _findings(differ: DataFrame) -> DataFrame:
    """What became of the records of ``differ`` (file, place, a, b): same bytes elsewhere in the file are the same record."""
    # repeats of one record are told apart by their order
    nth = "row_number() over (partition by file, {0}.hash order by place)"
    a = differ.where("a is not null").select("file", "place", "a", F.expr(nth.format("a")).alias("nth"))
    b = differ.where("b is not null").select("file", F.col("place").alias("b_place"), "b", F.expr(nth.format("b")).alias("nth"))
    same = a.join(b, (a["file"] == b["file"]) & (a["nth"] == b["nth"]) & (F.col("a.hash") == F.col("b.hash"))).select(a["file"], "place", "a", "b_place", "b", F.lit("moved").alias("status"))
    same = materialise(same, "merkle-moved")
    left = a.drop("nth").join(same.select("file", "place"), ["file", "place"], "left_anti")
    right = b.drop("nth").join(same.select("file", "b_place"), ["file", "b_place"], "left_anti").withColumn("place", F.col("b_place"))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("damaged")
    rest = left.join(right, ["file", "place"], "full").select("file", F.when(F.col("a").isNotNull(), F.col("place")).alias("place"), "a", "b_place", "b", status.alias("status"))
    both = same.unionByName(rest)
    return both.select("file", "place", F.col("a.start").alias("a_start"), F.col("a.end").alias("a_end"), "b_place", F.col("b.start").alias("b_start"), F.col("b.end").alias("b_end"), F.col("a.hash").alias("a_hash"), F.col("b.hash").alias("b_hash"), "status")


def planted_damage(draw: int, own: bytes) -> list[bytes]:
    """What might happen to a few members on a bad disk: a flipped byte, a lost tail, a lost record, a record that isn't in the other replica."""
    kind = draw % 997
    if kind == 1:
        middle = len(own) // 2
        return [own[:middle] + bytes([own[middle] ^ 0x40]) + own[middle + 1 :]]
    if kind == 2:
        return [own[:-7] + b"\0"]
    if kind == 3:
        return []
    if kind == 4:
        return [own, member(b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 0\r\n\r\n" + END)]
    return [own]


def op6_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of either replica, with what the audit says of it in the second."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = scratch_path(spark, "warc")
    write(pages, path, replicas={"a": None, "b": planted_damage})
    if not pages.head(1):
        leaves = [spark.createDataFrame([], LEAF)] * 2
    else:
        leaves = [materialise(read(spark, path, x), "warc-records") for x in "ab"]
    most = max(last_place(x) for x in leaves)
    found = audit(*[tree(x, most) for x in leaves])
    page = F.regexp_extract("record_id", r"<urn:x-record:(-?\d*)>", 1)
    first = leaves[0].select("file", "place", "record_id", F.col("start").alias("offset"), (F.col("end") - F.col("start")).alias("length"), F.col("hash").alias("record_sha256"))
    marks = found.where("place is not null").select("file", "place", F.col("b_hash").alias("replica"), "status")
    known = first.join(marks, ["file", "place"], "left").select("*", F.coalesce("status", F.lit("intact")).alias("said"))
    known = known.select(F.when(page != "", page.cast("long")).alias("page_id"), "file", "place", "offset", "length", "record_sha256", F.when(F.col("said") == "intact", F.col("record_sha256")).otherwise(F.col("replica")).alias("replica_sha256"), F.col("said").alias("status"))
    none = F.lit(None)
    extra = found.where("status = 'extra'").select(none.cast("long").alias("page_id"), "file", F.col("b_place").alias("place"), F.col("b_start").alias("offset"), (F.col("b_end") - F.col("b_start")).alias("length"), none.cast("string").alias("record_sha256"), F.col("b_hash").alias("replica_sha256"), "status")
    return known.unionByName(extra)


QUERIES = {"op6_merkle_audit": op6_merkle_audit}
ORACLES: dict[str, str] = {}
