"""Steps that must not grow faster than their input: texts worked out once, keys never broadcast, words with near options met no further."""

import itertools

import pytest
from pyspark.sql import functions as F

from inkwell.functions.distance import osa_many
from inkwell.operators import findings, known, phrases, realword, suggest, tokens
from inkwell.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_cut_once(spark):
    df = spark.createDataFrame([(1, "One two don't Anna's -- x.\n\n> no")], "doc_id long, text string")
    assert plan(tokens.words(df)).count("regexp_extract_all") == 1 + plan(tokens.prose_lines(df)).count("regexp_extract_all")
    assert [r.word for r in tokens.words(df).collect()] == ["one", "two", "don't", "anna"]


def test_keys_are_never_broadcast(spark):
    a = spark.createDataFrame([("abcd",), ("xyz",)], "word string")
    b = spark.createDataFrame([("abdc",), ("xy",), ("q",)], "word string")
    near = suggest.within(a, b, 1)
    assert "Broadcast" not in plan(near)
    assert sorted(map(tuple, near.collect())) == [("abcd", "abdc", 1), ("xyz", "xy", 1)]


def test_banded_distance_is_exact_up_to_its_bound():
    words = ["".join(w) for n in range(1, 5) for w in itertools.product("abc", repeat=n)][::2]
    a, b = zip(*itertools.product(words, words))
    whole, banded = osa_many(list(a), list(b)), osa_many(list(a), list(b), 2)
    assert ((whole <= 2) == (banded <= 2)).all() and (whole[whole <= 2] == banded[whole <= 2]).all()


def test_words_with_near_options_meet_none_beyond(spark):
    words = ["abcd", "zzzz"]
    options = ["abc", "abd", "abcde", "abef", "zzyy", "zzzy"]
    got = suggest.nearest(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(w,) for w in options], "word string"))
    assert sorted((r.word, r.other, r.distance, r.prefix, r.suffix) for r in got.collect()) == [
        ("abcd", "abc", 1, 3, 0), ("abcd", "abcde", 1, 4, 0), ("abcd", "abd", 1, 2, 1), ("zzzz", "zzyy", 2, 2, 0), ("zzzz", "zzzy", 1, 3, 0)
    ]


@pytest.mark.parametrize("stored", [None, [("a b", 1)]])
def test_gate_reads_its_runs_once(spark, stored):
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    rows = spark.createDataFrame([(1, "r", "a b c"), (2, "r", "a b c"), (3, "s", "a b d"), (4, "s", "x y z x y z")], "at long, register string, t string")
    runs = rows.select(F.udf(counted, "long")("at").alias("at"), "register", F.split("t", " ").alias("words"))
    before = None if stored is None else spark.createDataFrame(stored, "gram string, count long")
    got = {(r.gram, r.register): r["count"] for r in phrases.gated_counts(runs, ["at"], "register", most=3, stored=before).where("n = 3").collect()}
    first = 1 if stored is None else 2
    assert got == {("a b c", "r"): first, ("a b d", "s"): 1, ("x y z", "s"): 2, ("y z x", "s"): 1}
    assert seen.value == 4


def test_repeated_places_take_the_best_context(spark):
    """Texts of one id share places; as in the SQL, each context counts by itself."""
    rows = spark.createDataFrame([(1, "then", "a", "b"), (1, "then", "c", None)], "k long, word string, prev string, next string")
    grams = spark.createDataFrame([("a than", 3), ("than b", 1), ("c than", 5), ("a then", 2)], "gram string, count long")
    got = [tuple(r) for r in realword.evidence(rows, grams, ["k"]).collect()]
    assert got == [(1, "then", "than", 2, 5)]


@pytest.mark.parametrize("name", "lexicon_validity export_words export_strongest known_words shadow_words split_compounds suggest_candidates_d1 contractions_derived frequency_merge target_status own_vocabulary join_compounds realword_findings derive_cues status_maps prune_grams".split())
def test_texts_are_cut_once(spark, monkeypatch, name):
    calls, cut = [], tokens.prose_words
    monkeypatch.setattr(tokens, "prose_words", lambda *a, **k: calls.append(1) or cut(*a, **k))
    catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_findings_read_their_texts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    texts = [(1, "We saw teh plan and dont mind.\n\n> Zorblat\nThen zorblat came with Anna Smih here."), (2, "")]
    docs = spark.createDataFrame(texts, "k long, text string").select(F.udf(counted, "long")("k").alias("doc_id"), "text")
    words = [(w, 20) for w in "we saw the plan and mind then came with here".split()]
    d = known.tables(spark, dictionary=spark.createDataFrame(words, "word string, level int"), people=spark.createDataFrame([("anna smith", 4, "Anna Smith")], "name string, days long, display string"))
    got = {(r.line, r.col, r.word, r.suggestions[0].word) for r in findings.findings(docs, d).collect()}
    assert got == {(1, 8, "teh", "the"), (1, 21, "dont", "don't"), (4, 24, "Anna Smih", "Anna Smith")}
    assert seen.value == 2


def test_suggestions_broadcast_no_vocabulary(spark):
    asked = spark.createDataFrame([("abcd", False), ("abef", False)], "word string, want_name boolean")
    d = known.tables(spark, dictionary=spark.createDataFrame([("abc", 10), ("ab", 10), ("ef", 20)], "word string, level int"))
    out = suggest.suggestions(asked, d)
    assert "BroadcastExchange" not in plan(out) and "BroadcastExchange" not in plan(suggest.ranked(asked, d)) and "BroadcastExchange" not in plan(suggest.candidates(d))
    assert {r.word: [s.word for s in r.suggestions] for r in out.collect()} == {"abcd": ["abc", "ab"], "abef": ["ab ef", "ab", "abc"]}
