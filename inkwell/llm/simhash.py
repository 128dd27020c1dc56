"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are compared as sets of bits cut into partitions. If thresholds ``t_i`` of ``m`` partitions sum to
``distance - m + 1``, two fingerprints within ``distance`` bits agree within ``t_i`` bits in at least one
partition ``i`` (a threshold of -1 skips a partition). Correlated bits share a partition, so that the others
stay selective; the number of partitions and their unequal thresholds come from dynamic programming on estimated
candidate counts: exact for agreement within 0 bits, a Poisson-binomial over the bits' own frequencies beyond.

Work is on distinct fingerprints only: exact copies never meet each other. Probing and verifying run in blocks of one
probe value; a block returns a spanning forest of its verified links, never all pairs. A block with more than ``BLOCK``
fingerprints takes the exact way around: each of its fingerprints names the 65 points within one bit, and
fingerprints that share a point are within two bits of each other; a point has 65 such neighbours at most.

Wide fingerprints (:func:`wide_links`) serve larger distances: near copies of similarity 0.8 differ in about 15 % of the bits, which 64 bits tell
from chance too rarely. They are found by the same principle: ``CERTAIN + 1`` partitions of ``WIDE`` bits, correlated bits together, thresholds from the same
dynamic programming. Here both sides of a pair name the values within one bit, so a threshold of 2 costs no more rows than one of 1. Pairs within
``CERTAIN`` bits always meet; pairs beyond it that meet count up to ``REACH`` of the ``CARRIED`` bits that travel with each probe. A text at similarity 0.8
shares no partition with a probability of about 0.002, at 0.85 of 0.00004. A value with more than ``PIECE`` fingerprints is cut into pieces, and
every two of them meet on their own: exact, and no two pieces' rows have to be with any other's.

Edge cases: a null or empty text has fingerprint zero, linked like any other. Rows with a null id take the component of
their text and are never its name; a component whose ids are all null has a null name. Repeated rows stay. An empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, unit_hash
from .components import components

BITS = 64
SEED = 42
BLOCK = 1024
#: Relative cost of one probe row against one candidate pair that is verified in numpy.
ROW_COST = 20.0
MOST_PARTITIONS = 5
WIDE = 512
CARRIED = 256
CERTAIN = 41
REACH = 64
PIECE = 8192
#: Fingerprints that the plan of wide partitions is estimated from; it decides costs, never what is certain.
SAMPLE = 4096
#: Place of a partition's value and of a pair of pieces in a probe's key.
VALUE_BITS, PAIR_BITS = 20, 36
_SALTS = np.random.default_rng(SEED).integers(0, 1 << 64, WIDE // 64, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit majority fingerprint of the XXH64 hashes of word shingles, as a signed integer."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    digest, seed = xxhash.xxh64_intdigest, SEED
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), seed)]
    else:
        line, ends, at = b" ".join(words), [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *(e + 1 for e in ends[:-shingle])]
        hashes = [digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=True)]
    block = 1 << 16
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), block):
        ones += np.unpackbits(np.array(hashes[i : i + block], dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``key, fp`` for each row."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=[key, "fp"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, fp long")


def _bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Count of fingerprints and, for each pair of bits, how often both are set; 64 sums of 64 numbers reach the driver."""

    def run(batches):
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(np.asarray(batch.column(0)).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            both += bits.T @ bits
            n += len(bits)
        rows = [*both.ravel().tolist(), float(n)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.float64())], names=["at", "n"])

    sums = nodes.select("fp").mapInArrow(run, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for at, n in sums:
        flat[at] = n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def partition_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt to ``parts`` partitions of equal width, correlated bits together: each partition grows by the bit that correlates most with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    related = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)).tolist()
    free, out = set(range(len(both))), []
    for k in range(parts):
        width = len(free) // (parts - k)
        first = max(free, key=lambda b: (sum(related[b][c] for c in free), -b))
        group = [first]
        free.discard(first)
        while len(group) < width:
            best = max(free, key=lambda b: (max(related[b][c] for c in group), -b))
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def _value(bits: list[int]):
    """Column expression for the bits of ``fp`` in a partition: a mask keeps them in place."""
    mask = 0
    for b in bits:
        mask |= 1 << b
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))


def _beyond(n: int, same: float, p: np.ndarray, bits: list[int], most: int) -> list[float]:
    """Estimated pairs within 0..most bits of each other in one partition."""
    differ = 2 * p[bits] * (1 - p[bits])
    dist = np.zeros(most + 2)
    dist[0] = 1.0
    for q in differ:
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    pairs = n * (n - 1) / 2
    base = max(dist[0] * pairs, 1e-9)
    return [max(same, base) * float(dist[: t + 1].sum() / max(dist[0], 1e-300)) for t in range(most + 1)]


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds of -1 and more with the given sum and the least total cost, by dynamic programming; ``costs[i][t]`` is partition i's at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, len(row)):
                c = cost + (row[t] if t >= 0 else 0.0)
                if total + t not in new or c < new[total + t][0]:
                    new[total + t] = (c, [*chosen, t])
        best = new
    return best.get(budget, (float("inf"), []))


def plan(nodes: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """Partitions of bits and their thresholds, skipped partitions left out."""
    n, both = _bit_statistics(nodes)
    p = np.diag(both) / max(n, 1)
    options = {m: partition_bits(n, both, m) for m in range(min(2, distance + 1), MOST_PARTITIONS + 1)}
    flat = [(m, i, bits) for m, groups in options.items() for i, bits in enumerate(groups)]
    # pairs that agree in a partition: from the sizes of its groups, all counted in one aggregation
    probes = nodes.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _value(bits).alias("v")) for k, (_, _, bits) in enumerate(flat)])).alias("x")).select("x.*")
    sizes = probes.groupBy("k", "v").count().groupBy("k").agg(F.sum(F.col("count") * (F.col("count") - 1.0) / 2).alias("pairs")).collect()
    same = {k: pairs for k, pairs in sizes}
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for m, groups in options.items():
        costs = []
        for i, bits in enumerate(groups):
            k = flat.index((m, i, bits))
            pairs = _beyond(n, float(same.get(k, 0.0)), p, bits, distance)
            rows = [1.0, 1.0 + len(bits), 1.0 + len(bits) + len(bits) * (len(bits) - 1) / 2][: distance + 1]
            costs.append([pairs[t] + ROW_COST * n * (rows[t] if t < len(rows) else float("inf")) for t in range(min(distance, 2) + 1)])
        cost, chosen = allocate(costs, distance - m + 1)
        if cost < best[0]:
            best = (cost, [(bits, t) for bits, t in zip(groups, chosen, strict=True) if t >= 0])
    return best[1]


def _flips(value, bits: list[int], threshold: int):
    """``value`` and all values that differ from it in up to ``threshold`` of ``bits``."""
    sign = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    masks = [0, *(1 << b for b in bits)] if threshold else [0]
    if threshold > 1:
        masks += [(1 << a) | (1 << b) for i, a in enumerate(bits) for b in bits[:i]]
    return F.transform(F.array(*[F.lit(sign(m)) for m in masks]), lambda m: value.bitwiseXOR(m))


def forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``distance`` bits among distinct fingerprints: breadth first from each one not yet reached."""
    left, out = values.astype("<i8").view(np.uint64), []
    while len(left):
        edge, left = left[:1], left[1:]
        while len(edge) and len(left):
            x, edge = edge[0], edge[1:]
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                out += [(int(x.view(np.int64)), int(y)) for y in left[near].view(np.int64)]
                edge, left = np.concatenate([edge, left[near]]), left[~near]
    return out


def links(nodes: DataFrame, distance: int = 2, block: int = BLOCK) -> DataFrame:
    """Links ``u, v`` that join the same components as all pairs of fingerprints within ``distance`` bits."""
    if distance > 2:
        raise ValueError("the way around large blocks is exact up to two bits")
    chosen = plan(nodes, distance)
    # a lambda of one argument: a second one would get the element's index
    named = lambda k: lambda v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    probes = [F.transform(_flips(_value(bits), bits, t), named(k)) for k, (bits, t) in enumerate(chosen)]
    if not probes:
        return nodes.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    rows = nodes.select("fp", F.explode(F.concat(*probes)).alias("x")).select("fp", "x.k", "x.v")
    sizes = rows.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = materialise(rows.join(sizes, ["k", "v"]), "probes")

    def run(column):
        import pandas as pd

        return pd.Series([[{"u": a, "v": b} for a, b in forest(np.unique(np.asarray(x, dtype=np.int64)), distance)] for x in column], dtype=object)

    verify = F.pandas_udf(run, "array<struct<u:long,v:long>>")
    small = sized.where(F.col("n") <= block).groupBy("k", "v").agg(F.collect_list("fp").alias("fps"))
    found = small.select(F.explode(verify("fps")).alias("x")).select("x.u", "x.v")
    # the way around: fingerprints within one bit of a common point are within two bits of each other
    near = sized.where(F.col("n") > block).select("fp").distinct()
    points = near.select("fp", F.explode(_flips(F.col("fp"), list(range(BITS)), 1)).alias("point"))
    shared = points.groupBy("point").agg(F.array_sort(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    # two bits: all of them belong together; one bit: those next to the point belong to it; none: distinct fingerprints never do
    hub = F.col("fps")[0] if distance == 2 else F.col("point")
    if distance < 2:
        shared = shared.where(F.lit(distance == 1) & F.array_contains("fps", F.col("point")))
    far = shared.select(hub.alias("u"), F.explode("fps").alias("v")).where("u <> v")
    return found.unionByName(far)


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """The ``WIDE``-bit majority fingerprint of distinct 64-bit hashes, each of them mixed with one salt for every 64 bits."""
    ones = np.zeros(WIDE, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 12):
        h = hashes[at : at + (1 << 12), None] ^ _SALTS
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        ones += np.unpackbits((h ^ (h >> np.uint64(31))).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def _packed(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def wide_plan(prints: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """``distance + 1`` partitions of bits and their thresholds, skipped partitions left out; estimated from a sample chosen by hash."""
    n = prints.count()
    some = prints.where(unit_hash(F.lit(SEED), F.col("node")) * F.lit(float(n)) < F.lit(float(SAMPLE))).select("fp").collect()
    bits = np.unpackbits(np.frombuffer(b"".join(bytes(r["fp"]) for r in some), dtype=np.uint8).reshape(-1, WIDE // 8), axis=1, bitorder="little").astype(np.float64)
    drawn = len(bits)
    both = bits.T @ bits
    p = np.diag(both) / max(drawn, 1)
    groups = partition_bits(drawn, both, distance + 1)
    costs = []
    for group in groups:
        _, sizes = np.unique(bits[:, group] @ (2.0 ** np.arange(len(group))), return_counts=True)
        same = float((sizes * (sizes - 1.0) / 2).sum()) * (n / max(drawn, 1)) ** 2
        pairs = _beyond(n, same, p, group, 2)
        rows = [1.0, 1.0 + len(group), 1.0 + len(group)]
        costs.append([a + ROW_COST * n * b for a, b in zip(pairs, rows, strict=True)])
    # as many partitions as this have thresholds of 0 on average
    return [(g, t) for g, t in zip(groups, allocate(costs, 0)[1], strict=True) if t >= 0]


def _probes(prints: DataFrame, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """``key, node, fp`` (the carried bits) for each value that a fingerprint names in each partition."""
    weights = np.zeros((WIDE, len(chosen)), dtype=np.float32)
    masks, owner = [], []
    for k, (bits, t) in enumerate(chosen):
        weights[bits, k] = 2.0 ** np.arange(len(bits))
        flips = [0, *(1 << i for i in range(len(bits)))] if t else [0]
        masks += flips
        owner += [k] * len(flips)
    place, flipped = np.array(owner, dtype=np.int64), np.array(masks, dtype=np.int64)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                whole = _packed(part.column(1), WIDE // 8)
                values = (np.unpackbits(whole, axis=1, bitorder="little").astype(np.float32) @ weights).astype(np.int64)
                keys = ((place << VALUE_BITS) | (values[:, place] ^ flipped)) << PAIR_BITS
                who = pa.array(np.repeat(np.arange(part.num_rows), len(place)))
                carried = pa.array([x[: CARRIED // 8].tobytes() for x in whole], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column(0).take(who), carried.take(who)], names=["key", "node", "fp"])

    return prints.select("node", "fp").mapInArrow(run, "key long, node long, fp binary")


def wide_forest(prints: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within ``reach`` bits: all where they are few, else a spanning forest of them."""
    n = len(prints)
    if n <= 512:
        apart = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2, dtype=np.uint16)
        i, j = np.nonzero(apart <= reach)
        i, j = i[i < j], j[i < j]
        if len(i) <= 2 * n:
            return i, j
    left, rows, out = np.arange(n), prints, []
    while len(left):
        edge, left, rows = [(left[0], rows[0])], left[1:], rows[1:]
        while edge and len(left):
            at, x = edge.pop()
            near = np.bitwise_count(rows ^ x).sum(axis=1, dtype=np.uint16) <= reach
            if near.any():
                found = left[near]
                out.append((np.full(len(found), at), found))
                edge += list(zip(found, rows[near], strict=True))
                left, rows = left[~near], rows[~near]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def wide_links(prints: DataFrame, distance: int = CERTAIN, reach: int = REACH, piece: int = PIECE) -> DataFrame:
    """Links ``u, v`` between nodes of ``prints`` (node long, fp binary of ``WIDE`` bits) that join the same components as all pairs that meet.

    Every pair within ``distance`` bits meets. Of pairs that meet, those within ``reach`` of the carried bits are linked; ``reach`` is at least ``distance``.
    """
    if not distance <= reach or distance + 1 > 1 << 6 or WIDE > VALUE_BITS * (distance + 1):
        raise ValueError("a distance that partitions of these bits do not serve")
    kinds = materialise(prints.groupBy("fp").agg(F.min("node").alias("node")), "prints")
    equal = prints.join(kinds.withColumnRenamed("node", "u"), "fp").where("u <> node").select("u", F.col("node").alias("v"))
    rows = _probes(kinds, wide_plan(kinds, distance))
    large = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > piece), "large")
    if not large.isEmpty():
        own, parts = F.pmod("node", "parts"), F.ceil(F.col("n") / piece)
        cut = rows.join(large.select("key", parts.alias("parts")), "key", "left")
        pairs = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
            F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda q: F.least(own, q) * F.col("parts") + F.greatest(own, q))
        )
        rows = cut.select("key", F.explode(pairs).alias("pair"), "node", "fp").select((F.col("key") + F.col("pair")).alias("key"), "node", "fp")

    def meet(batches):
        rest = None
        for batch in batches:
            keys, nodes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            fps = _packed(batch.column(2), CARRIED // 8).view(np.uint64)
            if rest is not None:
                keys, nodes, fps = (np.concatenate(x) for x in zip(rest, (keys, nodes, fps), strict=True))
            if not len(keys):
                continue
            # the last key may go on in the next batch
            last = int(np.searchsorted(keys, keys[-1]))
            rest = (keys[last:], nodes[last:], fps[last:])
            yield met(keys[:last], nodes[:last], fps[:last])
        if rest is not None:
            yield met(*rest)

    def met(keys, nodes, fps):
        bounds = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b - a > 1:
                i, j = wide_forest(fps[a:b], reach)
                if len(i):
                    us.append(nodes[a + i])
                    vs.append(nodes[a + j])
        u, v = np.concatenate(us), np.concatenate(vs)
        once = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1])], names=["u", "v"])

    far = rows.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "u long, v long").distinct()
    return far.unionByName(equal)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 2, block: int = BLOCK, shingle: int = 3) -> DataFrame:
    """``key, fp, component_id`` for each row of ``df``: the least key that links reach, the row's own included."""
    marked = materialise(fingerprints(df, key, text, shingle), "fingerprints")
    nodes = materialise(marked.groupBy("fp").agg(F.min(key).alias("least")), "nodes")
    roots = materialise(components(links(nodes, distance, block)), "roots")
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = materialise(named.select("fp", "root").join(names, "root").select("fp", "component_id"), "classes")
    return marked.join(by_fp, "fp").select(key, "fp", "component_id")


def op8_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash_pigeonhole": op8_simhash_pigeonhole}
ORACLES: dict[str, str] = {}
