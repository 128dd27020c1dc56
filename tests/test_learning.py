import json
import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import complexity, hooks, ingest, learn, maintain, phrases, seed, tokens, vocabulary
from inkwell.sources import readers, writers
from inkwell.sources.scratch import root
from inkwell.streaming import pipeline


def plain_gate(runs, most=5):
    """Runs fed one by one into a store: a longer gram counts once its prefix is stored twice."""
    stored = {}
    for _, register, words in runs:
        for n in range(2, most + 1):
            for i in range(len(words) - n + 1):
                gram = " ".join(words[i : i + n])
                if n == 2 or sum(c for (g, _), c in stored.items() if g == gram.rsplit(" ", 1)[0]) >= 2:
                    stored[gram, register] = stored.get((gram, register), 0) + 1
    return stored


def test_phrase_gate_like_a_store_fed_run_by_run(spark):
    rng = random.Random(4)
    for _ in range(4):
        runs = [(i, rng.choice("xy"), [rng.choice("abc") * 2 for _ in range(rng.randrange(1, 9))]) for i in range(25)]
        frame = spark.createDataFrame(runs, "at long, register string, words array<string>")
        got = {(r["gram"], r["register"]): r["count"] for r in phrases.gated_counts(frame, ["at"], "register").collect()}
        assert got == plain_gate(runs)


def test_gate_with_earlier_totals(spark):
    frame = spark.createDataFrame([(1, "x", ["a1", "b1", "c1"])], "at long, register string, words array<string>")
    before = spark.createDataFrame([("a1 b1", 1)], "gram string, count long")
    assert {r["gram"] for r in phrases.gated_counts(frame, ["at"], "register", stored=before).collect()} == {"a1 b1", "b1 c1", "a1 b1 c1"}
    assert {r["gram"] for r in phrases.gated_counts(frame, ["at"], "register").collect()} == {"a1 b1", "b1 c1"}


def test_collocations(spark):
    rows = [("of the", 30), ("of a", 25), ("in the", 25), ("on the", 20), ("high signal", 8)]
    got = phrases.collocations(spark.createDataFrame(rows, "gram string, count long")).collect()
    assert got[0]["gram"] == "high signal" and len(got) == 5
    one = spark.createDataFrame([(10.0, 10.0, 10.0, 10.0), (0.0, 0.0, 0.0, 0.0)], "a double, b double, c double, d double")
    assert [r[0] for r in one.select(phrases.log_likelihood(*map(F.col, "abcd"))).collect()] == [0.0, 0.0]
    assert phrases.collocations(spark.createDataFrame([], "gram string, count long")).count() == 0


def test_learning_respects_authorship(spark):
    rows = [(1, "a#1", "slack", "ship 42 widgets now", "user"), (2, "a#2", "doc", "other people words", "assistant"), (3, "a#3", "doc", "ship it\n\nGenerated with Claude\nmore", "user"), (4, "a#4", "doc", "$ ls -la\nlong prose lines have six words or more", "user")]
    out = learn.learned(spark.createDataFrame(rows, "id long, doc string, register string, body string, authored_by string"), ["id"])
    words = {r["word"]: (r["count"], r["sources"]) for r in out["words"].collect()}
    assert words["ship"] == (2, 2) and words["people"] == (0, 1) and "more" in words and "ls" not in words
    grams = {(r["gram"], r["register"]): r["count"] for r in out["grams"].collect()}
    assert ("ship it", "doc") in grams and ("ship widgets", "slack") not in grams and ("widgets now", "slack") in grams
    prose = {(r["register"], r["metric"]): r["value"] for r in out["prose"].collect()}
    assert prose["doc", "documents"] == 3 and prose["slack", "sentences"] == 1
    assert [(r["register"], r["score"]) for r in out["exemplars"].collect()] == [("doc", 8)]


def test_vocabulary(spark):
    rows = [("word", "Word", "observed", 1, 2), ("word", "WORD", "owned", 0, 1), ("word", "word", "tap", 3, 3)]
    r = vocabulary.upsert(spark.createDataFrame(rows, "word string, display string, provenance string, increment long, seq long")).first()
    assert (r["display"], r["provenance"], r["count"]) == ("WORD", "owned", 4)
    days = [("w", "a", "2026-01-01 01:00:00"), ("w", "b", "2026-01-01 09:00:00"), ("w", "c", "2026-03-14 00:00:00")]
    seen = spark.createDataFrame(days, "word string, doc string, first_seen string").withColumn("first_seen", F.to_timestamp("first_seen"))
    assert vocabulary.day_counts(seen).first()["days"] == 2 and vocabulary.document_counts(seen).first()["sources"] == 3
    kinds = spark.createDataFrame([("owned", False, None), ("owned", True, None), ("observed", False, None), ("tap", True, "person")], "p string, d boolean, k string")
    assert [x[0] for x in kinds.select(vocabulary.classify(F.col("p"), F.col("d"), F.col("k"))).collect()] == ["name", "word", "word", "person"]
    valid = spark.createDataFrame([("observed", 0), ("observed", 2), ("user", 9)], "p string, n long").select(vocabulary.validity(F.col("p"), F.col("n"))).collect()
    assert [round(v[0], 6) for v in valid] == [0.3, 0.475, 1.0]


def test_complexity(spark):
    r = complexity.from_counts(spark.createDataFrame([("ship", 5), ("rare", 1), ("scarce", 1)], "word string, count long")).first()
    assert (r["tokens"], r["types"], round(r["hapax_ratio"], 6)) == (7, 3, round(2 / 3, 6))
    empty = complexity.from_counts(spark.createDataFrame([], "word string, count long")).first()
    assert empty["tokens"] == 0 and empty["guiraud_r"] == 0.0
    for rows, want in (([(10, 4)], 0.0), ([(3, 1)], 0.0), ([(2, 2), (10, 1), (24, 1)], 8.986100)):
        got = complexity.spread(spark.createDataFrame(rows, "length long, count long")).first()[0]
        assert got == pytest.approx(want, abs=1e-4)


def test_seed_and_maintenance(spark):
    terms = spark.createDataFrame([("my-Tool", "tap", "a"), ("tool", "owned", "b"), ("x", "user", "c")], "term string, provenance string, source string")
    assert {(r["word"], r["provenance"]) for r in seed.merged(terms).collect()} == {("my-tool", "tap"), ("my", "tap"), ("tool", "owned")}
    core = seed.core_counts(spark.createDataFrame([("a", 0), ("b", 1), ("a", 2), ("c", 6)], "word string, rank int"))
    assert dict(core.collect()) == {"a": 1_000_000, "b": 500_000, "c": 142_857}
    mined = seed.mined_counts(spark.createDataFrame([("well-known don't a ship ship",)], "text string"))
    assert dict(mined.collect()) == {"don't": 1, "ship": 2}
    before = spark.createDataFrame([("ship", "mined", 9), ("b", "core", 900_000)], "word string, source string, count long")
    assert dict(seed.totals(seed.frequencies(core, mined, before)).collect()) == {"a": 1_000_000, "b": 900_000, "c": 142_857, "don't": 1, "ship": 2}
    grams = spark.createDataFrame([("the small",), ("tasks a0d376be-04f5",), ("odd words",)], "gram string")
    vouched = spark.createDataFrame([("the",), ("small",)], "word string")
    assert [r[0] for r in maintain.doomed_grams(grams).collect()] == ["tasks a0d376be-04f5"]
    assert {r[0] for r in maintain.doomed_grams(grams, vouched).collect()} == {"tasks a0d376be-04f5", "odd words"}
    present, manifest = (spark.createDataFrame([(w,) for w in x], "word string") for x in (["handwritten", "iriq"], ["old"]))
    shared, kept = maintain.installed(present, manifest, spark.createDataFrame([("contextdb",), ("iriq",)], "word string"))
    assert {r[0] for r in shared.collect()} == {"handwritten", "iriq", "contextdb"} and {r[0] for r in kept.collect()} == {"old", "contextdb"}
    assert {r[0] for r in maintain.uninstalled(shared, kept).collect()} == {"handwritten", "iriq"}


def test_ingest(spark):
    raw = spark.createDataFrame([('[{"body":"one","author":"Me"},{"author":"x"}]',), ('{"body":"two"}\n\n{"body":"three","author":"you"}',), ("not json",), (None,)], "value string")
    rows = ingest.records(raw)
    assert {r["body"] for r in rows.collect()} == {"one", "two", "three"}
    who = {r["body"]: r["authored_by"] for r in ingest.attributed(rows, ["me"]).collect()}
    assert who == {"one": "user", "two": "user", "three": "other"}
    keys = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("z", 1, "c")], "source_key string, turn int, body string")
    done = spark.createDataFrame([("z",)], "source_key string")
    assert [tuple(r) for r in ingest.claimed(keys, "turn", captured=done).collect()] == [("k", 1, "a")]
    actions = spark.createDataFrame([("Dan", "git", "add", 1), ("dan", "manual", "remove", 2), ("dan", "git", "add", 3), ("ann", "gh", "add", 1)], "handle string, source string, action string, seq int")
    assert {(r["handle"], r["denied"]) for r in ingest.identity_state(actions).collect()} == {("dan", True), ("ann", False)}
    known = spark.createDataFrame([("daniel", False)], "handle string, denied boolean")
    lines = spark.createDataFrame([("From: Daniel (ID: U1)",), ("From: Daniela (ID: U2)",)], "line string")
    assert [r["handle"] for r in ingest.learned_identities(lines, known).collect()] == ["u1"]


def test_readers(spark, tmp_path):
    text = "### Result\nFrom: Ada Lovelace <ada@x> (ID: U1)\nMessage_ts: 12.5\nText: hello\nthere\n---\nText: orphan\n---\nFrom: bob\nText:\nhi"
    rows = readers.transcripts(spark.createDataFrame([(text,), (None,)], "text string")).collect()
    assert [(r["author"], r["display"], r["source_key"], r["body"]) for r in rows] == [("U1", "Ada Lovelace", "slack:12.5", "hello\nthere"), ("bob", "bob", "slack:hi", "hi")]
    blob = json.dumps([{"body": "hey", "user": {"login": "a"}, "html_url": "u1", "replies": [{"body": "yo", "author": {"login": "b"}}]}])
    got = readers.comments(spark.createDataFrame([(blob,), (json.dumps({"stdout": blob}),), ("bad",)], "json string")).collect()
    assert sorted((r["author"], r["source_key"]) for r in got) == [("a", "u1"), ("a", "u1"), ("b", "gh:yo"), ("b", "gh:yo")]
    more = [json.dumps(json.dumps([{"body": " as a string ", "user": {"login": "c"}, "id": 7}])), json.dumps([{"body": "  ", "user": {"login": "c"}}, {"body": "x", "user": None}]), '{"stdout": "total 12"}', "[" * 3000 + "]" * 3000, '"not json"']
    assert [tuple(r) for r in readers.comments(spark.createDataFrame([(m,) for m in more], "json string")).collect()] == [("gh:7", "c", "c", "pr", " as a string ")]
    wrapped = spark.createDataFrame([(json.dumps({"results": "From: Bo (ID: U9)\nText: a\n\nb\n"}),), ("From:\nText: nobody",)], "text string")
    assert [(r["author"], r["body"], r["source_key"]) for r in readers.transcripts(wrapped).collect()] == [("U9", "a\n\nb", "slack:a\n\nb")]
    files = [("r/Cargo.toml", '[package]\nname = "x"\n[dependencies]\nserde = "1"\n# no = 1\n"quoted" = "2"\n[dev-dependencies]\ntempfile = "3"\n[profile]\nlto = true'), ("r/Gemfile", "gem 'rails'\n  gem \"puma\", '1'\n# gem 'no'"), ("r/package.json", '{"dependencies":{"@scope/name":"1"},"devDependencies":{"vite":"2"},"other":{"no":1}}')]
    assert {r[0] for r in readers.manifest_terms(spark.createDataFrame(files, "path string, text string")).collect()} == {"serde", "quoted", "tempfile", "rails", "puma", "scope/name", "vite"}
    urls = spark.createDataFrame([("  url = git@github.com:me/tool.git",), ("url = https://github.com/me/other",), ("name = x",)], "line string")
    assert {r[0] for r in readers.remote_terms(urls).collect()} == {"me", "tool", "other"}
    (tmp_path / "words.tsv").write_text("# list\nship\t10\nship\t20\nrare\t70\n")
    assert dict(readers.dictionary(spark, str(tmp_path / "words.tsv")).collect()) == {"ship": 10}
    (tmp_path / "repo" / ".git").mkdir(parents=True)
    (tmp_path / "repo" / "docs").mkdir()
    (tmp_path / "repo" / "docs" / "a.md").write_text("prose here")
    (tmp_path / ".hidden" / ".git").mkdir(parents=True)
    assert readers.repositories(str(tmp_path)) == [str(tmp_path / "repo")]
    assert [r["text"] for r in readers.markdown(spark, str(tmp_path / "repo")).collect()] == ["prose here"]
    writers.word_list(spark.createDataFrame([("b",), ("a",), ("b",)], "word string"), str(tmp_path / "list"))
    assert [r[0] for r in writers.read_words(spark, str(tmp_path / "list")).collect()] == ["a", "b"]
    (tmp_path / "t.txt").write_text("one\r\ntwo\n")
    assert [(r["line"], r["raw"]) for r in readers.text_lines(spark, str(tmp_path / "t.txt")).collect()] == [(1, "one"), (2, "two")]


def test_streams(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    rows = spark.createDataFrame([("d", 1, "---"), ("d", 2, "x"), ("d", 3, "---"), ("d", 4, "```"), ("d", 5, "code"), ("e", 1, "plain")], "doc_id string, seq long, raw string")
    rows.coalesce(1).write.parquet(f"{source}/lines")
    rows.where("seq < 0").union(spark.createDataFrame([("d", 6, "```"), ("d", 7, "prose")], rows.schema)).coalesce(1).write.mode("append").parquet(f"{source}/lines")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/lines")
    made = []
    pipeline.each_batch(pipeline.line_states(stream), lambda b, n: made.extend(b.collect()), f"{out}/c1").awaitTermination()
    assert sorted((r["doc_id"], r["line"], r["state"]) for r in made)[-1] == ("e", 1, "p") and len(made) == 8
    messages = spark.createDataFrame([("k1", "a"), ("k1", "b"), ("k2", "c")], "source_key string, body string")
    messages.coalesce(1).write.parquet(f"{source}/messages")
    got = []
    pipeline.each_batch(pipeline.claimed_once(spark.readStream.schema(messages.schema).parquet(f"{source}/messages")), lambda b, n: got.extend(b.collect()), f"{out}/c2").awaitTermination()
    assert sorted(r["source_key"] for r in got) == ["k1", "k2"]


def test_lines_and_scratch(spark):
    rows = spark.createDataFrame([(1, "a\r\nb\n"), (2, ""), (3, None), (4, "\n")], "id int, text string")
    assert [(r["id"], r["line"], r["raw"]) for r in tokens.lines(rows).orderBy("id", "line").collect()] == [(1, 1, "a"), (1, 2, "b"), (4, 1, "")]
    assert root(spark) == root(spark)


def test_hooks(spark):
    schema = "hook_event_name string, session_id string, prompt string, tool_name string, tool_input string, tool_response string"
    rows = [
        ("UserPromptSubmit", "s1", "<system-reminder>x</system-reminder>fix it", None, None, None),
        ("user-prompt-submit", "s1", "/help", None, None, None),
        ("PostToolUse", "s2", None, "mcp__gmail__send_message", '{"body":"dear all"}', None),
        ("post-tool-use", "s2", None, "slack_send_message", '{"text":"hi team"}', "From: bob\nText: yo"),
        ("PostToolUse", "s2", None, "bash", "bad json", "[]"),
        ("Stop", "s2", None, None, None, None),
        (None, None, None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, schema)
    assert sorted(tuple(r) for r in hooks.staged(frame).collect()) == [("email", "s2", "dear all"), ("prompt", "s1", "fix it"), ("slack", "s2", "hi team")]
    assert sorted(r["kind"] for r in hooks.responses(frame).collect()) == ["github", "slack"]
    messages = spark.createDataFrame([("k1", "U1", "Ada L", "slack", "a"), ("k1", "U1", "Ada L", "slack", "a"), ("k2", "u2", "Bob", "slack", "b"), ("k3", "u1", "Ada L", "slack", "c")], "source_key string, author string, display string, register string, body string")
    mine = spark.createDataFrame([("u1", False), ("u2", True)], "handle string, denied boolean")
    done = spark.createDataFrame([("k3",)], "source_key string")
    assert [r["source_key"] for r in hooks.own_messages(messages, mine, done).collect()] == ["k1"]
    assert hooks.own_messages(messages, mine.where("false"), done).count() == 0
    assert {(r["name"], r["display"], r["count"]) for r in hooks.people(messages).collect()} == {("ada l", "Ada L", 3), ("bob", "Bob", 1)}
    times = spark.createDataFrame([(None, "2026-02-01"), ("2026-01-01", "2026-01-15"), ("2026-01-01", "2026-02-15")], "a string, b string")
    assert [r[0] for r in times.select(hooks.seed_due(F.to_timestamp("a"), F.to_timestamp("b"))).collect()] == [True, False, True]
