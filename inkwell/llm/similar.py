"""Near copies: SimHash candidates by the generalised pigeonhole principle, verified by exact similarity of word shingles.

Two texts are near copies if the Jaccard similarity of their sets of ``WORDS``-word shingles is ``LEAST`` or more. Candidates come from
:func:`simhash.wide_links`, over wide majority fingerprints of these sets. At similarity 0.8 a pair never meets there with a probability of about 0.002,
above it less. Every candidate is verified on the whole sets, so nothing is linked by an estimate.

Work is on distinct texts: exact copies never meet each other. The links that the fingerprints give are a spanning forest, so a link that
fails may stand for a pair that would not. So the components of verified links that a failed link joins form a group, whose members are
compared further. For ``ROUNDS`` rounds, every component in a group is compared, by a text of it drawn anew, with one of the group's
largest component: a straggler of a large group is mostly like one of a few dozen members of it, so it needn't meet them all. What is still
apart meets by its rarest shingles: similar sets always share one of these (prefix filter), texts that merely share a common passage do not.
Only pairs that are not yet in one component and whose sketches allow the similarity are verified. A sketch has the parity of the number of shingles
in each of its slots; two sets differ in no fewer shingles than their sketches in bits, so this loses nothing.

Edge cases: a null text counts as empty; texts without words are one component; a shorter text is one shingle; only A-Z and ASCII white
space are folded. Rows with a null id take the component of their text and never name it. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import materialise
from .components import components

WORDS = 5
LEAST = 0.8
SEED = 42
ROUNDS = 2
#: Bits of a sketch: a power of two, at least 64.
SKETCH = 1024
#: Sets that are in a worker's memory at once.
BATCH = 512
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    import xxhash

    own = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in own), dtype=np.uint64, count=len(own))
    n = max(len(h) - words + 1, min(len(h), 1))
    total = np.zeros(n, dtype=np.uint64)
    for k in range(min(words, len(h))):
        total = _mixed(total * _STEP + h[k : k + n])
    return np.unique(total)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the shingles' numbers by slot, packed into longs."""
    odd = np.bincount((hashes >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prints_of(texts: DataFrame) -> DataFrame:
    """``node, fp`` of each text with words."""

    def run(batches):
        for batch in batches:
            found = [(node, simhash.wide_fingerprint(h)) for node, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if len(h := shingles(t.as_py()))]
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "fp"])

    return texts.select("node", "text").mapInArrow(run, "node long, fp binary")


def _sets_of(texts: DataFrame) -> DataFrame:
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                found = [shingles(t.as_py()) for t in batch.column(1)]
                columns = [pa.array(x, pa.list_(pa.int64())) for x in ([h.view(np.int64) for h in found], [sketch(h) for h in found])]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["node", "hashes", "sketch"])

    return texts.select("node", "text").mapInArrow(run, "node long, hashes array<long>, sketch array<long>")


def _allowed(sizes: Column, least: float) -> Column:
    """Whether the sketches of ``u`` and ``v``, whose sizes add up to ``sizes``, allow the similarity."""
    bits = sum((F.bit_count(F.get("u_sketch", i).bitwiseXOR(F.get("v_sketch", i))) for i in range(1, SKETCH // 64)), F.bit_count(F.get("u_sketch", 0).bitwiseXOR(F.get("v_sketch", 0))))
    return bits * F.lit(1 + least) <= F.lit(1 - least) * sizes + 1e-9


def verified(pairs: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs ``u, v`` whose sets are similar enough."""
    a, b = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"{x}_set"), F.col("sketch").alias(f"{x}_sketch")) for x in ("u", "v"))
    total = F.size("u_set") + F.size("v_set")
    # a pair that sizes or sketches alone rule out is not read further
    sizes = F.least(F.size("u_set"), F.size("v_set")) >= F.lit(least) * F.greatest(F.size("u_set"), F.size("v_set")) - 1e-9
    both = F.size(F.array_intersect("u_set", "v_set"))
    return pairs.join(a, "u").join(b, "v").where(sizes & _allowed(total, least)).where(both * F.lit(1 + least) >= F.lit(least) * total - 1e-9).select("u", "v")


def _merged(near: DataFrame, links: DataFrame) -> DataFrame:
    """``near`` (node, root) after its components are joined by ``links`` (u, v) between nodes."""
    for x in ("u", "v"):
        links = links.join(near.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")), x)
    between = links.select(F.col("u_root").alias("u"), F.col("v_root").alias("v"))
    further = materialise(components(between), "further").select(F.col("node").alias("root"), F.col("root").alias("top"))
    return materialise(near.join(further, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "near")


def _groups(near: DataFrame, links: DataFrame) -> DataFrame:
    """``node, group`` for the nodes of components that ``links`` join though no verified link does."""
    for x in ("u", "v"):
        links = links.join(near.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")), x)
    apart = links.where("u_root <> v_root").select(F.col("u_root").alias("u"), F.col("v_root").alias("v"))
    tops = components(apart).select(F.col("node").alias("root"), F.col("root").alias("group"))
    return near.join(tops, "root").select("node", "group")


def _drawn(placed: DataFrame, turn: int) -> DataFrame:
    """Pairs ``u, v`` of one round over ``placed`` (group, node, root): in each group, one node of each component and one of the largest."""
    draw = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node")).getField("node")
    some = placed.groupBy("group", "root").agg(draw.alias("u"), F.count(F.lit(1)).alias("n"))
    most = some.groupBy("group").agg(F.max(F.struct("n", "root", "u")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    met = some.join(most, "group").where("root <> top.root")
    return met.select(F.least("u", "top.u").alias("u"), F.greatest("u", "top.u").alias("v")).distinct()


def prefixes(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """``group, node, root, sketch, n, hash, rest`` for the rarest shingles of each set, as many as two similar sets must share one of: all but ``least`` of them, and one more.

    ``rest``: how many shingles of the set, this one included, are not rarer; two sets share no more than that from their first common shingle on.
    """
    each = rows.select("group", "node", F.explode("hashes").alias("hash"))
    often = each.groupBy("group", "hash").agg(F.count(F.lit(1)).alias("often"))
    ranked = each.join(often, ["group", "hash"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "hash"))).alias("all")).withColumn("n", F.size("all"))
    # the 1e-9 as in ``verified``
    kept = F.slice("all", F.lit(1), (F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).cast("int"))
    placed = F.transform(kept, lambda x, i: F.struct(x["often"].alias("often"), x["hash"].alias("hash"), (F.col("n") - i).alias("rest")))
    few = ranked.select("node", "n", F.explode(F.filter(placed, lambda x: x["often"] > 1)).alias("x"))
    return few.join(rows.select("group", "node", "root", "sketch"), "node").select("group", "node", "root", "sketch", "n", "x.hash", "x.rest")


def _body(text: str) -> Column:
    """A text; an empty one where it has no words."""
    return F.when(F.col(text).rlike(r"[^ \t\n\x0b\f\r]"), F.col(text)).otherwise("")


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """``key, component_id`` for each row of ``df``: the least key that links reach, the row's own included."""
    marked = df.select(F.col(key), F.xxhash64(_body(text)).alias("node"))
    return marked.join(classes(df, key, text, least), "node").select(key, "component_id")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row of ``df``, with its columns, for each component: of its texts the one with the least key (a key before none, then by the text's hash).

    Rows that repeat this key and text are one document: the least of them by its other columns. Unlike texts that share a key are rows of
    their own components, so both stay. Columns must be of ordered types.
    """
    whole, node = F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.xxhash64(_body(text)).alias("node")
    rows = df.select(node, F.col(key).alias("k"), whole.alias("row"))
    by_node = classes(df, key, text, least).select("node", "root")
    first = F.min(F.struct(F.col("k").isNull().alias("none"), "k", "node"))
    chosen = rows.select("node", "k").join(by_node, "node").groupBy("root").agg(first.alias("first")).select(F.col("first.node").alias("node"), F.col("first.k").alias("first_k"))
    # a text is chosen for one component only, so rows of one node are repeats
    kept = rows.join(chosen, "node").where(F.col("k").eqNullSafe(F.col("first_k"))).groupBy("node").agg(F.min("row").alias("row"))
    return kept.select("row.*")


def classes(df: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """``node`` (a distinct text's hash), ``root`` (its component's) and ``component_id`` (the component's least key)."""
    marked = df.select(F.col(key), F.xxhash64(_body(text)).alias("node"), _body(text).alias("text"))
    nodes = materialise(marked.groupBy("node").agg(F.min(key).alias("least"), F.first("text").alias("text")), "texts")
    links = materialise(simhash.wide_links(materialise(_prints_of(nodes), "prints")), "links")
    members = materialise(links.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "members")
    sets = materialise(_sets_of(nodes.join(members, "node", "left_semi")), "sets")
    near = _merged(members.select("node", F.col("node").alias("root")), materialise(verified(links, sets, least), "links"))
    groups = materialise(_groups(near, links), "groups")
    for turn in range(ROUNDS):
        found = materialise(verified(_drawn(groups.join(near, "node"), turn), sets, least), "links")
        if found.isEmpty():
            break
        near = _merged(near, found)
    # then every pair of a group that may be similar and is not in one component
    placed = groups.join(near, "node")
    split = placed.groupBy("group").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("group")
    open_ = placed.join(split, "group", "left_semi").select("group", "node", "root")
    met_again = materialise(prefixes(open_.join(sets, "node"), least), "prefixes")
    left, right = (met_again.select("group", "hash", *[F.col(c).alias(f"{x}_{c}") for c in ("node", "root", "sketch", "n", "rest")]) for x in ("u", "v"))
    enough = F.least("u_rest", "v_rest") * F.lit(1 + least) >= F.lit(least) * (F.col("u_n") + F.col("v_n")) - 1e-9
    pairs = left.join(right, ["group", "hash"]).where("u_node < v_node and u_root <> v_root").where(enough & _allowed(F.col("u_n") + F.col("v_n"), least))
    cross = materialise(pairs.select(F.col("u_node").alias("u"), F.col("v_node").alias("v")).distinct(), "cross")
    near = _merged(near, verified(cross, sets, least))
    named = nodes.select("node", "least").join(near, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialise(named.join(names, "root").select("node", "root", "component_id"), "classes")
