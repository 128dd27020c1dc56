import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import language as lid

WORDS = {
    "en": ["the", "and", "with", "river", "morning", "which", "thought", "under", "stones"],
    "fr": ["le", "les", "avec", "rivière", "matin", "était", "pensée", "sous", "pierres"],
    "de": ["der", "und", "mit", "fluss", "morgen", "welche", "gedanke", "unter", "steine"],
}


def prose(code, n, rng):
    return " ".join(rng.choices(WORDS[code], k=n)).capitalize() + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = []
    for i in range(150):
        code = rng.choice(list(WORDS))
        out.append((i, prose(code, rng.randrange(8, 60), rng), code, f"host-{code}" if i % 2 else "shared", None))
    return out


def test_identifies_and_rejects(spark, docs, rows):
    df = docs(rows)
    model = lid.train(df)
    odd = [(900, None, "en", "shared", 0), (901, "", None, None, 0), (902, "12 34 !!", "en", "x", 0), (903, "Шшш ццц жжж щщщ ыыы эээ ююю" * 5, "en", "y", 0), (904, "und der fluss", None, None, 0)]
    out = lid.identify(docs(rows + odd + rows[:1]), model, declared=F.col("lang"), host=F.col("source")).collect()
    got = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows) + len(odd) + 1
    assert all(got[r[0]]["language"] == r[2] and got[r[0]]["accepted"] for r in rows)
    assert [got[i]["accepted"] for i in (900, 901, 902, 903, 904)] == [False, False, False, False, True]
    assert got[904]["language"] == "de" and got[903]["language"] == lid.UND


def test_rare_languages_and_copies(docs, rows):
    """Every declared language is learned, however many copies another has; the sample has each text once."""
    rng = random.Random(4)
    many = [(1000 + i, prose("en", 30, rng) if i % 3 else "the same and the same which", "en", None, None) for i in range(3000)]
    rare = [(9000 + i, prose("de", 30, rng), "de", None, None) for i in range(5)]
    df = docs(many + rare + [(9100, prose("fr", 20, rng), "fr", None, None)])
    sample = [(r["d"], r["t"]) for r in lid.training_texts(df, rows=100).collect()]
    assert len(sample) == len(set(sample)) and 60 < sum(d == "en" for d, _ in sample) < 140 and sum(d == "de" for d, _ in sample) == 5
    assert lid.train(df, rows=100).languages == ("de", "en")


def test_wrong_declarations_teach_nothing(docs, rows):
    foreign = [(2000, "шшш ццц жжж щщщ ыыы эээ " * 9, "en", None, None), (2001, "ωωω ψψψ ξξξ φφφ " * 5, "en", None, None), (2002, "日本語 文字" * 9, "fr", None, None)]
    swapped = [(3000, prose("de", 40, random.Random(1)), "en", None, None)]
    plain, mixed = lid.train(docs(rows)), lid.train(docs(rows + foreign + swapped))
    assert plain.languages == mixed.languages and np.allclose(plain.logs, mixed.logs)


def test_matches_brute_force(spark, docs, rows):
    model = lid.train(docs(rows))
    odd = [(900, "le the", "fr", "host-fr", 0), (901, "under unter", None, "host-de", 0), (902, "sous", "de", None, 0)]
    whole = rows + odd
    suffix = F.when(F.col("source").startswith("host"), F.lit("h"))
    out = {r["doc_id"]: r for r in lid.identify(docs(whole), model, declared=F.col("lang"), suffix=suffix, host=F.col("source")).collect()}
    known = [*model.languages, lid.UND]
    ll = {r[0]: model.likelihoods(r[1]) for r in whole}
    best = {k: int(v.argmax()) for k, v in ll.items()}

    def tally(keep):
        n = np.zeros(len(known))
        for r in whole:
            if keep(r):
                n[best[r[0]]] += 1
        return n

    root = (tally(lambda r: True) + 1) / (len(whole) + len(known))
    spoke = tally(lambda r: r[2])
    for r in whole:
        prior = root
        if r[3] and r[3].startswith("host"):
            n = tally(lambda x: x[3] and x[3].startswith("host"))
            prior = (n + lid.LEAN * prior) / (n.sum() + lid.LEAN)
        if r[3]:
            n = tally(lambda x: x[3] == r[3])
            prior = (n + lid.LEAN * prior) / (n.sum() + lid.LEAN)
        log = ll[r[0]] + np.log(prior)
        if r[2]:
            said = tally(lambda x: x[2] == r[2])
            log = log + np.log((said + lid.LEAN * (said.sum() + 1) / (spoke.sum() + len(known))) / (spoke + lid.LEAN))
        p = np.exp(log - log.max())
        assert out[r[0]]["language"] == known[int(p.argmax())]
        assert abs(out[r[0]]["posterior"] - p.max() / p.sum()) < 1e-9


def test_no_labels_and_empty_tables(spark, docs):
    df = docs([(1, "some words here", None, None, 0)])
    got = lid.identify(df, lid.train(df), declared=F.col("lang"), host=F.col("source")).collect()
    assert [(r["language"], r["accepted"]) for r in got] == [("und", False)]
    assert lid.identify(docs([]), lid.train(docs([])), declared=F.col("lang")).count() == 0


def test_long_text_in_blocks(spark, docs, rows, monkeypatch):
    model = lid.train(docs(rows))
    text = " ".join(r[1] for r in rows) * 20
    whole = model.likelihoods(text)
    monkeypatch.setattr(lid, "BLOCK", 1000)
    assert np.allclose(whole, model.likelihoods(text))


def test_pages(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        code = rng.choice(list(WORDS))
        rows.append((i, f"https://m.site{i % 7}.example.{code}/{i}", f'<!DOCTYPE html><html lang="{code}"><script>var the = "and with";</script><p class="x">{prose(code, 20, rng)}</p></html>'))
    rows += [(500, None, None), (501, "not a url", "<html><p>123</p></html>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in lid.pages_language(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and not got[500]["accepted"] and not got[501]["accepted"]
    assert all(got[i]["language"] == u.rsplit(".", 1)[1].split("/")[0] for i, u, _ in rows[:120])
