import random

import corpus_pipeline as cp
from inkwell.llm import similar


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_components(texts):
    sets, root = [plain_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if likeness(a, sets[j]) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in range(len(texts))}


def with_changes(text, n, rng):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def pairs(rng, n=60):
    """Texts and near copies of them, between 0.75 and 0.97 similar."""
    out = []
    while len(out) < 2 * n:
        size = rng.randrange(200, 1000)
        one = " ".join(f"w{rng.randrange(3000)}" for _ in range(size))
        other = with_changes(one, rng.randrange(1, max(2, size // 30)), rng)
        if 0.75 <= likeness(plain_set(one), plain_set(other)) <= 0.97:
            out += [one, other]
    return out


def test_stage_drops_near_copies(spark, docs, tmp_path):
    texts = pairs(random.Random(3))
    near = [likeness(plain_set(a), plain_set(b)) for a, b in zip(texts[::2], texts[1::2], strict=True)]
    assert sum(0.8 <= x < 0.95 for x in near) > 20 and any(x < 0.8 for x in near)
    kept = {r["doc_id"] for r in cp.near_duplicates(spark, docs(list(enumerate(texts))), str(tmp_path)).collect()}
    assert kept == set(plain_components(texts).values())


def test_components_match_brute_force(docs):
    rng = random.Random(8)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(400))
    # a group of one passage, a chain whose ends are unlike, short texts, case and white space
    texts = [with_changes(base, k % 9, rng) for k in range(60)]
    chain = [" ".join(f"c{i}" for i in range(k, k + 100)) for k in range(0, 120, 8)]
    texts += chain + ["One", "one ", "a b c d", "A b\nc  d", "a b c d e", "x\x1cy b c d", "é É x y z"]
    texts += [base.upper(), None, "", " \t\n"]
    got = {r["doc_id"]: r["component_id"] for r in similar.near_copies(docs([(i, t) for i, t in enumerate(texts)])).collect()}
    assert got == plain_components(texts)


def test_ids_and_empty_table(docs):
    rows = [(5, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "quite other words here"), (5, "a b c d")]
    got = sorted(map(str, ((r["doc_id"], r["component_id"]) for r in similar.near_copies(docs(rows)).collect())))
    assert got == sorted(map(str, [(5, 3), (3, 3), (None, 3), (None, None), (5, 3)]))
    assert similar.near_copies(docs([])).count() == 0


def test_stage_gets_its_pairs_from_the_simhash_operator(docs, tmp_path, monkeypatch):
    """Without the operator's links nothing is a near copy; with them the stage drops one of the two."""
    rng = random.Random(4)
    one = " ".join(f"w{rng.randrange(3000)}" for _ in range(300))
    df = docs([(0, one), (1, with_changes(one, 3, rng)), (2, "quite other words stand in here")])
    kept = lambda: {r["doc_id"] for r in cp.near_duplicates(None, df, str(tmp_path)).collect()}
    assert kept() == {0, 2}
    links, used = similar.simhash.wide_links, []
    monkeypatch.setattr(similar.simhash, "wide_links", lambda prints: used.append(prints) or links(prints).limit(0))
    assert kept() == {0, 1, 2} and len(used) == 1
