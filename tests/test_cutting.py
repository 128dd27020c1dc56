"""Texts cut in Arrow batches give the rows of the plain way."""

import pytest
from pyspark.sql import functions as F

from inkwell.operators import cutting, tokens
from inkwell.plans import catalogue

TEXTS = [
    "Don't we’re Anna's x's a-'s --so-- _is_ well-known'\r\nin 2024, ½ naïve Ÿes ªb x²y",
    "    indented\n\ttab\n> quoted\n ``` fence\n| a | b\n!!! ok ???\n\n",
    "see `code here` <b>bold</b> ./a/b (/etc/x) ~/y me@x.org http://x.y/z?q www.foo.de/bar baz.com, e.g. no.Where and.then",
    "bare site.comé and site.io’s or a.dev b", "Σίσυφος İstanbul ǅ ˮx 東京 words ét é", "“quoted” – it’s “x”‖y čas žena's", "a1 b2 one_two 3 - ' plain words", "", None, "a\x85b\x1cc d e\rf",
]


def rows(df, *columns):
    return sorted(df.select(*columns).collect(), key=repr)


def test_same_lines_runs_and_counts(spark):
    df = spark.createDataFrame([(i - 3, f"s{i % 2}", x) for i, x in enumerate(TEXTS)], "doc_id long, source string, text string").repartition(2)
    assert rows(cutting.lines(df), "doc_id", "source", "line", "words") == rows(tokens.prose_words(df), "doc_id", "source", "line", "words")
    assert rows(cutting.runs(df), "doc_id", "source", "line", "run", "words") == rows(tokens.runs(df), "doc_id", "source", "line", "run", "words")
    columns = ["word", "docs", "n", "first", "days"]
    assert rows(cutting.vocabulary(df), *columns) == rows(cutting.summed(cutting.by_document(tokens.words(df))), *columns)


def test_repeated_and_missing_documents_count_once(spark):
    df = spark.createDataFrame([(1, "one two"), (1, "two two"), (None, "two"), (-31, "one")], "doc_id long, text string")
    assert rows(cutting.vocabulary(df), "word", "docs", "n", "first", "days") == [("one", 2, 2, -31, 2), ("two", 1, 4, 1, 1)]


def test_tables_of_counts_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(cutting, "WORDS_HELD", 1)
    monkeypatch.setattr(cutting, "SLICE", 5)
    df = spark.createDataFrame([(i, "one two") for i in range(40)], "doc_id long, text string").coalesce(1)
    assert rows(cutting.vocabulary(df), "word", "docs", "n", "first", "days") == [("one", 40, 40, 0, 30), ("two", 40, 40, 0, 30)]


@pytest.mark.parametrize("name", ["target_status", "known_words", "join_compounds", "derive_cues", "phrases_g2_by_register"])
def test_plain_texts_are_cut_in_batches(spark, monkeypatch, name):
    """The plain way gets odd texts only."""
    got, cut = [], tokens.prose_words
    monkeypatch.setattr(tokens, "prose_words", lambda d, *a, **k: got.append(d) or cut(d, *a, **k))
    catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sum(d.where(F.length("text") > 0).count() for d in got) == 0
