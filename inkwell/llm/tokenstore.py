"""Content-addressed store for token ids.

Ids are cut into chunks where a rolling hash of the last ``WINDOW`` ids hits a pattern, so equal passages give equal chunks
wherever they stand. A chunk's address is the SHA-256 of its bytes; the store holds each address once. A document is a
recipe: its chunk addresses in order and the Merkle root over them. The manifest holds roots over all recipes, in ascending order of ids.

Files under the given path (Parquet):
  ``objects/``   address, n, payload (little-endian ids of the store's width); partitioned by kind, see below
  ``recipes/``   block, place, key, before (ids of the block's earlier rows), n_tokens, addresses, root; file after file in ascending key order
  ``manifest/``  block, first and last key, rows, tokens, root of each block of recipes, and the ids of all blocks before it
  ``head/``      blocks, rows, tokens and the root over all blocks' roots

One shuffle moves chunk payloads and recipes together, with partial aggregation by address, so a chunk that thousands of documents share
is sent once by each map task. Reading checks every payload against its address, every recipe against its root, every block's rows against the
manifest and the manifest against the head: a lost or altered object, recipe or block is an error.

Edge cases: a null text counts as empty and still gets its end id. Rows with a null key come first in the order. Rows that
repeat a key (or have none) stay separate rows, in the order of their texts' hashes. An empty table gives an empty store. Ids beyond the store's width raise an error.
Only key and text are stored, so other columns never clash; a key named like a column of a result is called ``key`` there.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import scratch_path, table

END_ID = 2
WINDOW = 4
#: Chunk sizes in ids: at least, on average beyond that, at most.
LEAST, MEAN, MOST = 64, 256, 1024
MANIFEST_ROWS = 1 << 14
CACHE_PIECES = 500_000
_GEAR = np.random.default_rng(1977).integers(0, 1 << 63, size=1 << 16, dtype=np.uint64)
#: A space between two characters that are white space under no definition: tokens never cross it.
_CUT = re.compile("(?<=[^\\s\x1c-\x1f\x85\u200b\u180e]) (?=[^\\s\x1c-\x1f\x85\u200b\u180e])")
#: White space other than single spaces and line ends inside a text.
_ODD_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]")
_LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_SIGNS = r"!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~"
#: Between single spaces and line ends: letters before signs or an end, signs before an end, a line end, or whatever else stands there.
_PIECE = re.compile(rf" ?[{_LETTERS}]++(?=[{_SIGNS}]*+(?:[ \n]|\Z))| ?[{_SIGNS}]++(?=[ \n]|\Z)|\n| ?[^ \n]++")
#: A piece that is one word of the byte-level pattern, whatever its length.
_WORD = re.compile(rf" ?[{_LETTERS}]+| ?[{_SIGNS}]+")


class Encoder(dict):
    """The tokenizers library over pieces of a text that no token crosses; a piece's ids are worked out when it is first looked up.

    A piece that is one word of a byte-level tokenizer goes to the library's model at once, any other through the whole tokenizer.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.word = self.tokenizer.model.tokenize
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"] or {}
        self.byte_level = steps.get("type") == "ByteLevel" and steps.get("use_regex") and not steps.get("add_prefix_space") and not spec.get("normalizer")
        self.symbols = dict(enumerate(byte_symbols()))

    def __missing__(self, piece: str) -> bytes:
        if (known := self.older.get(piece)) is not None:
            self[piece] = known
            return known
        if self.byte_level and _WORD.fullmatch(piece):
            plain = piece.replace(" ", "Ġ") if piece.isascii() else piece.encode().decode("latin-1").translate(self.symbols)
            ids = [t.id for t in self.word(plain)]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        self[piece] = out = array("I", ids).tobytes()
        return out

    def pieces(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.byte_level:
            return [text]
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n" or _ODD_SPACE.search(text):
            parts = _CUT.split(text)
            return [parts[0], *(" " + p for p in parts[1:])]
        return _PIECE.findall(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self) > CACHE_PIECES:
            # what is still in use comes back from the older half
            self.older = dict(self)
            self.clear()
        get = self.__getitem__
        return [np.frombuffer(b"".join(map(get, self.pieces(t))), dtype=np.uint32) for t in texts]


def marks(ids: np.ndarray) -> np.ndarray:
    """Positions after which a rolling hash (a sum of the last ids' random words, each turned by its distance) allows a cut."""
    words = _GEAR[(ids & 0xFFFF).astype(np.int64)]
    if len(ids) and ids.max() > 0xFFFF:
        words = words ^ (ids >> 16).astype(np.uint64)
    rolling = words.copy()
    for k in range(1, min(WINDOW, len(ids))):
        rolling[k:] += (words[:-k] << np.uint64(k)) | (words[:-k] >> np.uint64(64 - k))
    return np.flatnonzero(rolling >> np.uint64(40) & np.uint64(MEAN - 1) == 0) + 1


def cut_points(n: int, allowed: np.ndarray, first: int = 0) -> list[int]:
    """Ends of the chunks of ``n`` ids from position ``first`` of the stream that ``allowed`` marks, within the size limits.

    A chunk is longer than the hash's window, so what stands before a text in the stream never matters.
    """
    out, at = [], 0
    i = np.searchsorted(allowed, first)
    while n - at > LEAST:
        i += np.searchsorted(allowed[i:], first + at + LEAST)
        end = min(int(allowed[i]) - first if i < len(allowed) else n, at + MOST, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary SHA-256 tree; an odd node goes up unchanged. No leaves: the hash of nothing."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    level = leaves
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\x01" + level[i] + level[i + 1]).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(level) - len(level) % 2 :]
    return level[0]


def crc_append(crc: int, other: int, other_len: int) -> int:
    """CRC-32 of two byte strings joined, from their own CRCs and the second one's length."""
    return _zeros(crc, other_len) ^ other


def _times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


#: Operators that run 2**k zero bytes through a CRC register; each is the square of the one before.
_SHIFTS: list[list[int]] = []
_BYTES_SHIFT: dict[int, list[int]] = {}


def _shift(k: int) -> list[int]:
    if not _SHIFTS:
        bit = [0xEDB88320, *(1 << i for i in range(31))]
        for _ in range(3):
            bit = [_times(bit, x) for x in bit]
        _SHIFTS.append(bit)
    while len(_SHIFTS) <= k:
        _SHIFTS.append([_times(_SHIFTS[-1], x) for x in _SHIFTS[-1]])
    return _SHIFTS[k]


def _zeros(crc: int, n: int) -> int:
    if n not in _BYTES_SHIFT:
        if len(_BYTES_SHIFT) > 1 << 15:
            _BYTES_SHIFT.clear()
        matrix, k, left = [1 << i for i in range(32)], 0, n
        while left:
            if left & 1:
                matrix = [_times(_shift(k), x) for x in matrix]
            left >>= 1
            k += 1
        _BYTES_SHIFT[n] = matrix
    return _times(_BYTES_SHIFT[n], crc)


#: What a zero-byte operator does to each value of each of the four bytes of a register.
_TABLES: dict[int, np.ndarray] = {}


def _table(k: int) -> np.ndarray:
    if k not in _TABLES:
        _TABLES[k] = np.array([[_times(_shift(k), v << (8 * byte)) for v in range(256)] for byte in range(4)], dtype=np.int64)
    return _TABLES[k]


def crcs_shifted(crcs: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Each CRC-32 run through its number of zero bytes."""
    out, k = crcs.astype(np.int64), 0
    while (left := zeros >> k).any():
        on = np.flatnonzero(left & 1)
        if len(on):
            t, x = _table(k), out[on]
            out[on] = t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]
        k += 1
    return out


_LOADED: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


MIXED = "kind string, address binary, key {key}, tie long, n int, payload binary, addresses array<binary>"


def write(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int | None = END_ID, width: int = 2) -> None:
    """Encode ``text``, append ``end_id`` and write the store under ``path``. ``width``: bytes of an id in payloads."""
    tokenizer, spark = tokenizer or default_path(), df.sparkSession
    dtype, limit = np.dtype(f"<u{width}"), 1 << (8 * width)
    kind = df.schema[key].dataType.simpleString()
    columns = [c.split(" ")[0] for c in MIXED.split(", ")]

    def run(batches):
        encoder = _encoder(tokenizer)
        tail = np.array([] if end_id is None else [end_id], dtype=np.uint32)
        for batch in batches:
            sent: set[bytes] = set()  # of this batch only: bounded, and the aggregation removes the rest
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                addresses, sizes, bodies, counts, owned = [], [], [], [], []
                coded = [x for ids in encoder.encode(part.column(2).to_pylist()) for x in (ids, tail)]
                stream = np.concatenate(coded)
                if len(stream) and int(stream.max()) >= limit:
                    raise ValueError(f"id {int(stream.max())} needs more than {width} bytes")
                raw, allowed, first = stream.astype(dtype).tobytes(), marks(stream), 0
                for ids in coded[::2]:
                    n, own, begin = len(ids) + len(tail), [], 0
                    for end in cut_points(n, allowed, first):
                        body = raw[(first + begin) * width : (first + end) * width]
                        own.append(hashlib.sha256(body).digest())
                        if own[-1] not in sent:
                            sent.add(own[-1])
                            addresses.append(own[-1])
                            sizes.append(end - begin)
                            bodies.append(body)
                        begin = end
                    counts.append(n)
                    owned.append(own)
                    first += n
                n, m, keyed = len(bodies), len(owned), part.column(0)
                many = pa.list_(pa.binary())
                objects = (pa.array(["objects"] * n, pa.string()), pa.array(addresses, pa.binary()), pa.nulls(n, keyed.type), pa.nulls(n, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bodies, pa.binary()), pa.nulls(n, many))
                links = (pa.array(["links"] * m, pa.string()), pa.nulls(m, pa.binary()), keyed, part.column(1), pa.array(counts, pa.int32()), pa.nulls(m, pa.binary()), pa.array(owned, many))
                yield pa.RecordBatch.from_arrays(list(objects), names=columns)
                yield pa.RecordBatch.from_arrays(list(links), names=columns)

    tie = F.xxhash64(F.col(text), F.when(F.col(key).isNull(), F.monotonically_increasing_id()))
    mixed = df.select(F.col(key), tie.alias("tie"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, MIXED.format(key=kind))
    # one exchange for both kinds: chunks meet by address; links keep to themselves by key and tie, repeated rows as a count
    # (the address leads: rows are sorted by it)
    one = mixed.groupBy("address", "key", "tie", "n", "addresses", "kind").agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("copies"))
    # payloads differ from each other: a column dictionary would only cost
    one.write.option("parquet.enable.dictionary", "false").partitionBy("kind").parquet(f"{path}/parts")
    _write_recipes(spark, path, key, kind)


RECIPE = "block int, place int, key {key}, before long, n_tokens long, addresses array<binary>, root binary"
RESULT = ("start", "n_tokens", "token_ids", "ids_crc32", "block", "place", "pos")
GROUP = 1 << 10


def _named(key: str) -> str:
    return "key" if key.lower() in RESULT else key


def _write_recipes(spark: SparkSession, path: str, key: str, kind: str) -> None:
    links = spark.read.schema(f"key {kind}, tie long, n int, addresses array<binary>, copies long, kind string").parquet(f"{path}/parts").where("kind = 'links'")
    rows = links.select("key", "tie", "n", "addresses", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    blocks = max(1, -(-int(links.agg(F.sum("copies")).first()[0] or 0) // MANIFEST_ROWS))
    order = [F.col("key").asc_nulls_first(), F.col("tie"), F.col("copy")]

    def number(batches):
        """Rows in their order: a partition is a block, as it is a file."""
        from pyspark import TaskContext

        block, place, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            m, sizes = batch.num_rows, np.asarray(batch.column(1)).astype(np.int64)
            ends = before + np.cumsum(sizes)
            lists = batch.column(2)
            flat, at, roots = lists.flatten().to_pylist(), 0, []
            for k in lists.value_lengths().to_pylist():
                roots.append(merkle(flat[at : at + k]))
                at += k
            columns = [pa.array(np.full(m, block, np.int32)), pa.array(np.arange(place, place + m, dtype=np.int32)), batch.column(0), pa.array(ends - sizes), pa.array(sizes), lists, pa.array(roots, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "place", "key", "before", "n_tokens", "addresses", "root"])
            if m:
                place, before = place + m, int(ends[-1])

    ranged = rows.repartitionByRange(blocks, *order).sortWithinPartitions(*order).select("key", "n", "addresses")
    ranged.mapInArrow(number, RECIPE.format(key=kind)).write.parquet(f"{path}/recipes")
    made = _blocks(_stored(spark, path, key, kind)).withColumn("g", F.expr(f"block div {GROUP}"))
    inner = made.select("*", F.expr("sum(tokens) over (partition by g order by block) - tokens").alias("inner_"))
    outer = made.groupBy("g").agg(F.sum("tokens").alias("t")).select("g", F.expr("sum(t) over (order by g) - t").alias("outer_"))
    inner.join(outer, "g").select("block", "first", "last", "rows", "tokens", "root", (F.col("inner_") + F.col("outer_")).alias("start")).write.parquet(f"{path}/manifest")
    _head(_manifest(spark, path, kind)).write.parquet(f"{path}/head")


def _merkle_of(column: str):
    return F.pandas_udf(lambda s: s.map(lambda a: merkle([x["root"] for x in a])), "binary")(column)


def _blocks(stored: DataFrame) -> DataFrame:
    """``block, first, last, rows, tokens, root`` as the recipes themselves have them; a block has about ``MANIFEST_ROWS`` rows."""
    sums = [F.min("key").alias("first"), F.max("key").alias("last"), F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("tokens")]
    made = stored.groupBy("block").agg(*sums, F.array_sort(F.collect_list(F.struct("place", "root"))).alias("roots"))
    return made.select("block", "first", "last", "rows", "tokens", _merkle_of("roots").alias("root"))


def _head(manifest: DataFrame) -> DataFrame:
    """One row over the manifest, by groups of blocks: blocks, rows, tokens, root."""
    sums = lambda n: [F.sum(n).alias("blocks"), F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens")]
    groups = manifest.groupBy(F.expr(f"block div {GROUP}").alias("place")).agg(*sums(F.lit(1)), F.array_sort(F.collect_list(F.struct("block", "root"))).alias("roots"))
    tops = groups.select("place", "blocks", "rows", "tokens", _merkle_of("roots").alias("root"))
    top = tops.agg(*sums("blocks"), F.array_sort(F.collect_list(F.struct("place", "root"))).alias("roots"))
    return top.select("blocks", "rows", "tokens", _merkle_of("roots").alias("root"))


def _kind(df: DataFrame, column: str = "key") -> str:
    return df.schema[column].dataType.simpleString()


def _stored(spark: SparkSession, path: str, key: str = "key", kind: str | None = None) -> DataFrame:
    reader = spark.read if kind is None else spark.read.schema(RECIPE.format(key=kind))
    return reader.parquet(f"{path}/recipes")


def _manifest(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(f"block int, first {kind}, last {kind}, rows long, tokens long, root binary, start long").parquet(f"{path}/manifest")


def verify(spark: SparkSession, path: str) -> None:
    """Raise an error unless recipes, manifest and head fit each other. Reads keys, sizes and roots only."""
    stored = _stored(spark, path)
    manifest = _manifest(spark, path, _kind(stored))
    head = spark.read.parquet(f"{path}/head")
    if not _head(manifest).exceptAll(head).isEmpty() or head.count() != 1:
        raise ValueError("the manifest does not fit its head")
    now = _blocks(stored).select("block", *[F.col(c).alias(f"own_{c}") for c in ("rows", "tokens", "root")])
    unlike = F.lit(False)
    for c in ("rows", "tokens", "root"):
        unlike = unlike | ~F.col(c).eqNullSafe(F.col(f"own_{c}"))
    bad = sorted(r["block"] for r in manifest.join(now, "block", "full").where(unlike).select("block").limit(10).collect())
    if bad:
        raise ValueError(f"recipes of blocks {bad} do not fit the manifest")


def objects(spark: SparkSession, path: str) -> DataFrame:
    """Stored chunks: address, n, payload."""
    return spark.read.schema("address binary, n int, payload binary, kind string").parquet(f"{path}/parts").where("kind = 'objects'").drop("kind")


def recipes(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``key, start, n_tokens, block, place, addresses, root`` of every document."""
    stored = _stored(spark, path)
    starts = _manifest(spark, path, _kind(stored)).select("block", "start")
    return stored.join(starts, "block").select(F.col("key").alias(_named(key)), (F.col("start") + F.col("before")).alias("start"), "n_tokens", "block", "place", "addresses", "root")


def _links(spark: SparkSession, path: str) -> DataFrame:
    """``key, start, n_tokens, block, place, pos, address``: a row for each chunk of each recipe that fits its root."""

    def run(batches):
        for batch in batches:
            lists = batch.column(5)
            flat, sizes = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            addresses, at = flat.to_pylist(), 0
            for k, root in zip(sizes.tolist(), batch.column(6).to_pylist(), strict=True):
                if merkle(addresses[at : at + k]) != root:
                    raise ValueError("a recipe does not fit its root")
                at += k
            owner = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            pos = np.arange(at) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([*(c.take(owner) for c in batch.columns[:5]), pa.array(pos.astype(np.int32)), flat], names=["key", "start", "n_tokens", "block", "place", "pos", "address"])

    rows = recipes(spark, path, "key")
    return rows.mapInArrow(run, f"key {_kind(rows)}, start long, n_tokens long, block int, place int, pos int, address binary")


def reconstruct(spark: SparkSession, path: str, key: str = "doc_id", width: int = 2) -> DataFrame:
    """``key, start, n_tokens, token_ids`` from the files alone; a payload that doesn't fit its address, and a lost one, raise an error."""
    verify(spark, path)

    def run(payloads, addresses):
        import pandas as pd

        out = []
        for body, address in zip(payloads, addresses, strict=True):
            if body is None:
                raise ValueError(f"object {address.hex()} is lost")
            if hashlib.sha256(body).digest() != address:
                raise ValueError(f"object {address.hex()} is damaged")
            out.append(np.frombuffer(body, dtype=f"<u{width}").astype(np.int64))
        return pd.Series(out, dtype=object)

    ids = F.pandas_udf(run, "array<long>")
    whole = _links(spark, path).join(objects(spark, path), "address", "left").select("key", "start", "n_tokens", "block", "place", "pos", ids("payload", "address").alias("ids"))
    parts = whole.groupBy("key", "start", "n_tokens", "block", "place").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("parts"))
    found = parts.select("block", "place", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("token_ids"))
    # a text without ids (no end id either) has a recipe without chunks
    heads = recipes(spark, path, "key").select(F.col("key").alias(_named(key)), "start", "n_tokens", "block", "place")
    return heads.join(found, ["block", "place"], "left").select(_named(key), "start", "n_tokens", F.coalesce("token_ids", F.array().cast("array<long>")).alias("token_ids"))


def checksums(spark: SparkSession, path: str, key: str = "doc_id", width: int = 2) -> DataFrame:
    """``key, start, n_tokens, ids_crc32`` from the files: each stored chunk is read, checked and summed once, and recipes combine the sums.

    CRC-32 of joined strings follows from the parts' CRCs and lengths, so payloads don't travel, and a document's chunks are
    summed as they stream by in order. A text without any ids (no end id either) has sum 0.
    """
    verify(spark, path)

    def sums(batches):
        for batch in batches:
            addresses, bodies = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for body, address in zip(bodies, addresses, strict=True):
                if hashlib.sha256(body).digest() != address:
                    raise ValueError(f"object {address.hex()} is damaged")
            crcs = [zlib.crc32(np.frombuffer(b, dtype=f"<u{width}").astype("<u4").tobytes()) for b in bodies]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], names=["address", "len", "crc"])

    made = objects(spark, path).select("address", "n", "payload").mapInArrow(sums, "address binary, len int, crc long")
    links = _links(spark, path)
    parts = links.join(made, "address", "left").select("block", "place", "pos", "key", "start", "n_tokens", "len", "crc")
    streamed = parts.repartition("block", "place").sortWithinPartitions("block", "place", "pos")

    def whole(batches):
        rest = None  # the chunks of the document that the last batch ended in
        for batch in batches:
            # only the documents whose last chunk is surely there: those before the batch's last one
            part = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()
            if not part:
                continue
            block, place = (np.asarray(part[0].column(i)) for i in (0, 1))
            last = int(np.flatnonzero((block != block[-1]) | (place != place[-1]))[-1]) + 1 if block[0] != block[-1] or place[0] != place[-1] else 0
            rest = part[0].slice(last)
            if last:
                yield _joined(part[0].slice(0, last))
        if rest is not None:
            yield _joined(rest)

    kind, name = _kind(links), _named(key)
    got = streamed.mapInArrow(whole, f"key {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("key", name)
    none = recipes(spark, path, key).where("n_tokens = 0").select(name, "start", "n_tokens", F.lit(0).cast("long").alias("ids_crc32"))
    return got.unionByName(none)


def _joined(rows: pa.RecordBatch) -> pa.RecordBatch:
    """``key, start, n_tokens, ids_crc32`` of the documents whose chunks are ``rows`` in order: block, place, pos, key, start, n_tokens, len, crc."""
    if rows.column(6).null_count:
        raise ValueError("an object is lost")
    block, place, total, sizes, crcs = (np.asarray(rows.column(i)).astype(np.int64) for i in (0, 1, 5, 6, 7))
    first = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (place[1:] != place[:-1])]))
    if (np.add.reduceat(sizes, first) != total[first]).any():
        raise ValueError("a document's chunks do not make its length")
    # the sum of a document is the XOR of its chunks' sums, each run through the zero bytes that follow in place of the later chunks
    ends = np.cumsum(sizes)
    upto = np.repeat(ends[np.append(first[1:], len(sizes)) - 1], np.diff(np.append(first, len(sizes))))
    whole = np.bitwise_xor.reduceat(crcs_shifted(crcs, 4 * (upto - ends)), first)
    at = pa.array(first)
    return pa.RecordBatch.from_arrays([rows.column(3).take(at), rows.column(4).take(at), pa.array(total[first]), pa.array(whole)], names=["key", "start", "n_tokens", "ids_crc32"])


def op2_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokenstore")
    write(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return checksums(spark, path)


QUERIES = {"op2_content_store": op2_content_store}
ORACLES: dict[str, str] = {}
