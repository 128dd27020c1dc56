import random

import xxhash

from inkwell.llm import simhash
from inkwell.llm.components import components


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    out = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return out - (1 << 64) if out >= 1 << 63 else out


def plain_components(fps, distance=2):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= distance:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_fingerprint_matches_definition():
    texts = [None, "", "  \t\n", "One", "a b", "a b c", "The THE the the", "É é x　y z", "a\x1cb c d", "word " * 5000]
    texts += [" ".join(random.Random(i).choices(["x", "Yy", "zz", "w\n"], k=i)) for i in range(60)]
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t), t[:40]


def near_set(n, seed):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 3, 12])):
            out.add(base - (1 << 64) if base >= 1 << 63 else base)
            for _ in range(rng.choice([1, 2, 3, 4])):
                base ^= 1 << rng.randrange(64)
    return list(out)


def classes(spark, fps, **options):
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    rows = components(simhash.links(nodes, **options)).collect()
    return {r["node"]: r["root"] for r in rows}


def same_split(found, fps, distance):
    plain = plain_components(fps, distance)
    groups = {}
    for f in fps:
        groups.setdefault(plain[f], set()).add(found.get(f, f))
    return all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_links_match_brute_force(spark):
    for seed in range(2):
        fps = near_set(400, seed)
        assert same_split(classes(spark, fps), fps, 2)


def test_way_around_large_blocks(spark):
    rng = random.Random(5)
    fps = list({sum(1 << b for b in rng.sample(range(12), rng.randrange(7))) for _ in range(300)}) + near_set(80, 9)
    for distance in (0, 1, 2):
        assert same_split(classes(spark, fps, block=3, distance=distance), fps, distance)


def test_allocation_is_least():
    costs = [[5, 9, 30], [1, 2, 3], [4, 4, 4]]
    from itertools import product

    for budget in (-3, -2, 0, 1, 4):
        best = min(sum(c[t] for c, t in zip(costs, ts) if t >= 0) for ts in product((-1, 0, 1, 2), repeat=3) if sum(ts) == budget)
        cost, chosen = simhash.allocate(costs, budget)
        assert cost == best and sum(chosen) == budget


def test_edges_and_ties(spark, docs):
    rows = [(5, "a b c d"), (3, "a b c d"), (7, None), (9, ""), (None, "a b c d"), (None, "quite other words here"), (9, ""), (1, "Z " * 3000)]
    got = sorted(map(str, ((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs(rows)).collect())))
    want = sorted(map(str, [(5, 3), (3, 3), (7, 7), (9, 7), (None, 3), (None, None), (9, 7), (1, 1)]))
    assert got == want
    assert simhash.near_duplicates(docs([])).count() == 0


def test_long_chain_is_one_component(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5, 5), (7, 6)], "u long, v long")
    rows = components(edges).collect()
    assert {r["root"] for r in rows} == {0} and len(rows) == n + 1


def wide_set(n, seed):
    """Wide fingerprints in groups, each a chain of steps of 1 to 41 bits; and pairs that are certain to meet."""
    import numpy as np

    rng = np.random.default_rng(seed)
    prints, certain = [], []
    for _ in range(n):
        bits = rng.integers(0, 2, simhash.WIDE, dtype=np.uint8)
        prints.append(np.packbits(bits, bitorder="little").tobytes())
        for _ in range(int(rng.choice([0, 1, 5]))):
            bits = bits.copy()
            bits[rng.choice(simhash.WIDE, int(rng.integers(1, simhash.CERTAIN + 1)), replace=False)] ^= 1
            prints.append(np.packbits(bits, bitorder="little").tobytes())
            certain.append((len(prints) - 2, len(prints) - 1))
    prints.append(prints[0])  # equal fingerprints of two nodes
    return prints, [*certain, (0, len(prints) - 1)]


def test_wide_fingerprints_meet_within_the_certain_distance(spark):
    """Also where a value's fingerprints are cut into pieces; no link joins fingerprints of unlike groups."""
    prints, certain = wide_set(120, 4)
    nodes = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(prints)], "node long, fp binary")
    group = {}
    for i in range(len(prints)):
        group[i] = next((group[a] for a, b in certain if b == i), i)
    for piece in (simhash.PIECE, 2):
        roots = {r["node"]: r["root"] for r in components(simhash.wide_links(nodes, piece=piece)).collect()}
        assert {i: roots.get(i, i) for i in group} == group


def test_wide_fingerprints_meet_at_similarity_of_four_fifths(spark):
    """Sets of 9 to 900 shingles of which eight in nine are shared: nearly all pairs are linked."""
    import numpy as np

    rng, rows = np.random.default_rng(5), []
    for k in range(400):
        n = 9 * int(rng.choice([1, 4, 20, 100]))
        some = rng.integers(0, 1 << 64, n + n // 9, dtype=np.uint64)
        rows += [(2 * k, bytearray(simhash.wide_fingerprint(some[:n]))), (2 * k + 1, bytearray(simhash.wide_fingerprint(some[n // 9 :])))]
    found = {(r["u"], r["v"]) for r in simhash.wide_links(spark.createDataFrame(rows, "node long, fp binary")).collect()}
    assert all(v == u + 1 and u % 2 == 0 for u, v in found) and len(found) >= 0.98 * 400
