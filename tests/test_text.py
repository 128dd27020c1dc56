import random
import re

import pytest
from pyspark.sql import functions as F

from inkwell.functions import authorship, lets, mask
from inkwell.functions import text as tx
from inkwell.functions.distance import delete_keys, osa, osa_many


def values(spark, texts, column):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r[0] for r in frame.orderBy("i").select(column(F.col("x"))).collect()]


def test_tokens_and_normal_forms(spark):
    got = values(spark, ["don't stop -- now", "--flag don't. 'quoted' _x_ a_b", "naïve Ünïcode's 42nd", "--- ''", "User's"], tx.tokens)
    assert got == [["don't", "stop", "now"], ["flag", "don't", "quoted", "x", "a_b"], ["naïve", "Ünïcode's", "42nd"], [], ["User's"]]
    assert values(spark, ["User's", "DON'T", "it's's"], tx.normalise) == ["user", "don't", "it's"]
    assert values(spark, ["“It’s” – a test"], tx.fold_typography) == ["\"It's\" - a test"]


def test_predicates(spark):
    words = ["ok", "word", "Word", "don't", "well-known", "API", "URLs", "IDs", "v2ray", "camelCase", "naïve", "As", "as", "--", "a", "-x"]
    assert values(spark, words, tx.is_checkable) == [False, True, True, True, True, False, False, False, False, False, False, False, False, False, False, False]
    assert values(spark, ["ab", "a", "--", "a-", "é1", "don't"], tx.is_lexical) == [True, False, False, True, False, True]
    lines = ["plain words here", "    indented", "\ttabbed", "", "   ", "```rust", "$ ls", "> quote", "| a | b |", "x = {1: 2}; [y];", "Dear all, it's fine.", "--- *** ---"]
    assert values(spark, lines, tx.is_prose) == [True, False, False, False, False, False, False, False, False, False, True, False]


def test_sentences_and_syllables(spark):
    assert values(spark, ["One. Two! Three", "...", "Wait... what? Yes", "no end"], lambda c: F.transform(tx.sentences(c), lambda s: F.trim(s))) == [["One.", "Two!", "Three"], [], ["Wait.", ".. what?", "Yes"], ["no end"]]
    words = {"the": 1, "simple": 2, "table": 2, "make": 1, "idea": 2, "rhythm": 1, "ale": 1, "queue": 1, "xyz": 1, "bcd": 1, "people": 2}
    assert dict(zip(words, values(spark, list(words), tx.syllables), strict=True)) == {k: plain_syllables(k) for k in words}
    assert {k: plain_syllables(k) for k in ("the", "simple", "make")} == {"the": 1, "simple": 2, "make": 1}


def plain_syllables(w):
    n = len(re.findall("[aeiouy]+", w))
    if n > 1 and w.endswith("e") and not re.search("[^aeiouy]le$", w):
        n -= 1
    return max(n, 1)


def test_sentences_like_a_scan(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab. !?\n1é-") for _ in range(rng.randrange(25))) for _ in range(500)]

    def scan(t):
        out, now = [], ""
        for c in t:
            now += c
            if c in ".!?" and any(x.isalnum() for x in now):
                out.append(now)
                now = ""
        return [*out, now] if any(x.isalnum() for x in now) else out

    assert values(spark, texts, tx.sentences) == [scan(t) for t in texts]


def test_identifiers(spark):
    assert values(spark, ["NixOS/nixpkgs", "winget-pkgs", "fooBar_baz.v2", "HTTPServer", ""], tx.split_identifier) == [["nix", "nixpkgs"], ["winget", "pkgs"], ["foo", "bar", "baz"], ["server"], []]
    assert values(spark, [' "my-Tool" ', "a", "x.y/zed"], tx.expand_term) == [["my", "my-tool", "tool"], [], ["zed"]]


def test_small_helpers(spark):
    frame = spark.createDataFrame([("aviod", "avoid"), ("thm", "them"), ("", "x"), ("abc", "acb"), ("form", "from")], "a string, b string")
    got = [tuple(r) for r in frame.select(tx.is_subsequence(F.col("a"), F.col("b")), tx.common_prefix(F.col("a"), F.col("b"))).collect()]
    assert got == [(False, 2), (True, 2), (True, 0), (False, 1), (False, 1)]
    rounds = spark.createDataFrame([(0.285,), (1.005,), (-0.125,), (2.5,)], "x double").select(lets.round_half_away(F.col("x"), 2)).collect()
    assert [r[0] for r in rounds] == [0.28, 1.0, -0.13, 2.5]
    lines = spark.createDataFrame([("from daniela (id:u2)", "daniel"), ("by daniel (id:u1)", "daniel"), ("x@daniel.org", "daniel"), ("", "")], "l string, k string")
    assert [r[0] for r in lines.select(tx.appears_bounded(F.col("l"), F.col("k"))).collect()] == [False, True, False, False]
    grams = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>").select(tx.ngrams(F.col("w"), 2)).collect()
    assert [r[0] for r in grams] == [["a b", "b c"], [], []]
    runs = spark.createDataFrame([(["ship", "42", "red", "widgets", "é"],), ([],)], "w array<string>").select(tx.lexical_runs(F.col("w"))).collect()
    assert [r[0] for r in runs] == [[["ship"], ["red", "widgets"]], []]


def plain_mask(line):
    out = list(line)
    for pattern in (mask.CODE, mask.TAG, mask.EMAIL, r"(?<![^\s(><\"'=\[{:,|`])/\S*|~/\S*|\./\S*", mask.IRI):
        for m in re.finditer(pattern, line):
            out[m.start() : m.end()] = " " * (m.end() - m.start())
    return "".join(out)


def test_mask_is_a_union_over_the_line(spark):
    rng = random.Random(7)
    lines = ["z`a`@y", "see https://github.com/x/y and `foo_bar` now", "<b>bold</b> a < b > c", "run ./x ~/y /usr/bin and a/b", "me@x.org, you", "e.g. etc.The end", "plain"]
    lines += ["".join(rng.choice("ab `<>/@~. :") for _ in range(rng.randrange(25))) for _ in range(800)]
    got = values(spark, lines, mask.mask)
    assert all(len(g) == len(x) for g, x in zip(got, lines, strict=True))
    assert got == [plain_mask(x) for x in lines]
    assert got[5] == lines[5] and got[6] == lines[6]


def test_authorship(spark):
    bodies = ["hello\nCo-Authored-By: Claude <x>\nrest", "🤖 Generated with [Claude](http://x)", "we generated with claude", "plain", "a\n\n* vibed with claude\nb", ""]
    assert values(spark, bodies, authorship.is_assistant) == [True, True, False, False, True, False]
    assert values(spark, bodies, authorship.marker) == ["co-authored-by: claude", "generated with claude", None, None, "vibed with claude", None]
    assert values(spark, bodies, authorship.strip_trailer) == ["hello", "", "we generated with claude", "plain", "a", ""]
    prompts = ["<system-reminder>x</system-reminder> fix it", "go <command-args>rest", "/slash", "  ", "a <div>b</div>"]
    assert values(spark, prompts, authorship.typed_prompt) == ["fix it", "go", None, None, "a <div>b</div>"]


def plain_osa(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = i + j
                continue
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(7)))
    return [("aviod", "avoid"), ("ca", "abc"), ("", ""), ("", "ab")] + [(word(), word()) for _ in range(1500)]


def test_distance(spark, pairs):
    want = [plain_osa(a, b) for a, b in pairs]
    assert osa_many([a for a, _ in pairs], [b for _, b in pairs]).tolist() == want
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)] + [(-1, None, "x")], "i int, a string, b string")
    assert [r[0] for r in frame.orderBy("i").select(osa(F.col("a"), F.col("b"))).collect()] == [None, *want]
    assert want[0] == 1 and want[1] == 3


def test_near_words_share_a_key(spark, pairs):
    frame = spark.createDataFrame([(a, b) for a, b in pairs if plain_osa(a, b) <= 2], "a string, b string")
    assert frame.where(~F.arrays_overlap(delete_keys(F.col("a")), delete_keys(F.col("b")))).count() == 0


def test_handles_with_quotation_marks(spark):
    rows = spark.createDataFrame([("by a\\Eb!", "a\\Eb"), ("by xa\\Eb!", "a\\Eb"), ("by [z](", "[z]("), ("by a", "")], "hay string, needle string")
    assert [r[0] for r in rows.select(tx.appears_bounded(F.col("hay"), F.col("needle"))).collect()] == [True, False, True, False]
