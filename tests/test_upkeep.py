import json

from inkwell.operators import identity, maintain, spool, targets
from inkwell.sources import writers


def test_spool(spark):
    empty = spark.createDataFrame([], spool.SPOOL)
    rows = spark.createDataFrame([("slack", "s1", f"body {i}", "user") for i in range(5)] + [("note", None, "z", "other")], "register string, source string, body string, authored_by string")
    full = spool.spooled(empty, rows, 10, ["register", "body"])
    assert [(r["id"], r["body"]) for r in full.orderBy("id").collect()][:2] == [(11, "z"), (12, "body 0")]
    batch, left = spool.drain(full, 2)
    assert [(r["id"], r["doc"]) for r in batch.collect()] == [(11, "capture#11"), (12, "s1#12")]
    assert sorted(r["id"] for r in left.collect()) == [13, 14, 15, 16]


def test_messages_are_claimed_with_the_spool(spark):
    empty = spark.createDataFrame([], spool.SPOOL)
    messages = spark.createDataFrame([("k1", "Me", "Me", "slack", "one"), ("k1", "me", "Me", "slack", "one"), ("k2", "me", "Me", "slack", "two"), ("k3", "you", "You", "slack", "three")], "source_key string, author string, display string, register string, body string")
    me = spark.createDataFrame([("me", False)], "handle string, denied boolean")
    full, keys = spool.claimed_into(empty, messages, me, spark.createDataFrame([("k2",)], "source_key string"), 0)
    assert [(r["id"], r["source"], r["authored_by"]) for r in full.collect()] == [(1, "k1", "user")]
    assert {r[0] for r in keys.collect()} == {"k1", "k2"}


def test_dispatch(spark):
    kind = "hook_event_name string, session_id string, prompt string, tool_name string, tool_input string, tool_response string"
    sent = json.dumps({"text": "sent words"})
    events = [("UserPromptSubmit", "s", "a typed prompt", None, None, None), ("UserPromptSubmit", "s", "/help", None, None, None), ("PostToolUse", "s", None, "mcp_slack_send_message", sent, None), ("SessionStart", "s", None, None, None, None), (None,) * 6]
    empty = spark.createDataFrame([], spool.SPOOL)
    left, batch = spool.dispatched(spark.createDataFrame(events, kind), empty, 0)
    assert batch is None and {r["body"] for r in left.collect()} == {"a typed prompt", "sent words"}
    left, batch = spool.dispatched(spark.createDataFrame([*events, ("Stop", "s", None, None, None, None)], kind), empty, 0)
    assert batch.count() == 2 and left.count() == 0


def test_identities(spark):
    hosts = "github.com:\n    users:\n        ada:\n            oauth_token: x\n        bob:\n    git_protocol: https\n    user: ada\nother.org:\n    users:\n        eve:\n"
    got = identity.from_hosts(spark.createDataFrame([(hosts,), ("",), (None,)], "text string"))
    assert {tuple(r) for r in got.collect()} == {("ada", "gh"), ("bob", "gh"), ("eve", "gh")}
    lines = spark.createDataFrame([("user.name=Ada L",), ("user.email = a@x",), ("core.editor=vi",)], "line string")
    assert {r["handle"] for r in identity.from_settings(lines).collect()} == {"Ada L", "a@x"}
    commits = spark.createDataFrame([("r", i, "Ada L" if i % 2 else "Bob", f"A{i}@x" if i != 3 else "none") for i in range(60)], "repository string, place int, author string, email string")
    found = identity.from_commits(commits, spark.createDataFrame([("ada l",)], "handle string"))
    assert {r["handle"] for r in found.collect()} == {f"a{i}@x" for i in range(1, 40, 2) if i != 3}


def test_targets(spark, tmp_path):
    entries = spark.createDataFrame([("iriq", "owned", 3, 0.9), ("zed", "observed", 1, 0.5), ("plain", "user", 1, 1.0)], "word string, provenance string, sources int, validity double")
    known = spark.createDataFrame([("plain",)], "word string")
    folder = f"file://{tmp_path}"
    writers.word_list(spark.createDataFrame([("mine",)], "word string"), f"{folder}/LocalDictionary")
    for t in targets.TARGETS:
        targets.sync(entries, known, folder, t)
    rows = {r["name"]: (r["present"], r["ours"], r["total"]) for r in targets.status(spark, folder).collect()}
    assert rows == {"vscode": (True, 1, 1), "wisprflow": (True, 1, 1), "macos": (True, 1, 2)}
    targets.unsync(spark, folder, targets.find("macos"))
    assert [r[0] for r in writers.read_words(spark, f"{folder}/LocalDictionary").collect()] == ["mine"]
    assert targets.find("nowhere") is None
    assert {r["name"]: r["present"] for r in targets.status(spark, f"{folder}/none").collect()} == {"vscode": False, "wisprflow": False, "macos": False}


def test_lexicon_changes(spark):
    lexicon = spark.createDataFrame([("ship", "observed"), ("tool", "tap")], "word string, provenance string")
    assert {tuple(r) for r in maintain.added_words(lexicon, spark.createDataFrame([("Ship",), (" ",)], "word string")).collect()} == {("ship", "user"), ("tool", "tap")}
    grams = spark.createDataFrame([("a b", "x"), ("a b", "y"), ("b c", "x")], "gram string, register string")
    assert [r["gram"] for r in maintain.removed_phrase(grams, "a b").collect()] == ["b c"]


def test_finding_sinks(spark, tmp_path):
    found = spark.createDataFrame([(2, "unknown", "teh", 1, 4, [("the", 1.0), ("tea", 0.2)], 0.7), (1, "unknown", "zz", 3, 1, [], 0.35)], "doc_id long, kind string, word string, line int, col int, suggestions array<struct<word:string,score:double>>, confidence double")
    writers.findings_json(found, f"file://{tmp_path}/json")
    assert [x["word"] for x in json.loads(spark.read.text(f"file://{tmp_path}/json").first()[0])] == ["zz", "teh"]
    writers.findings_text(found, f"file://{tmp_path}/text")
    assert sorted(r[0] for r in spark.read.text(f"file://{tmp_path}/text").collect()) == ["1:3:1 unknown zz", "2:1:4 unknown teh -> the, tea"]
