"""Sources: texts, JSON records, message transcripts, nested JSON, repositories' files, dictionaries and cue tables."""

from __future__ import annotations

import json
import os
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.ingest import RECORD, records

SKIPPED_FOLDERS = ("node_modules", "vendor", "target", "dist", "build", "tmp", ".git", ".venv")
FILES_PER_REPOSITORY, BYTES_PER_FILE, DEPTH = 60, 200_000, 3


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line, raw``: files as wholes first, so that line numbers hold before anything is shuffled."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    lines = whole.select("path", F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")).alias("at", "raw"))
    return lines.select("path", (F.col("at") + 1).alias("line"), "raw")


def text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder as ``path, text``."""
    return spark.readStream.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Records, one object a line; lines that don't parse or have no body are left out."""
    return spark.read.schema(RECORD).json(path).where("body is not null")


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of files that hold an array of objects, or one object a line."""
    return records(spark.read.text(path, wholetext=True))


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """Hook payloads, one a line; bad JSON gives an empty payload."""
    schema = "hook_event_name string, session_id string, prompt string, tool_name string, tool_input string, tool_response string"
    return spark.read.text(path).select(F.coalesce(F.from_json("value", schema), F.from_json(F.lit("{}"), schema)).alias("p")).select("p.*")


MESSAGE = "source_key string, author string, display string, register string, body string"
#: A rule or a heading ends a message, and so does the next one's ``From:`` line.
_BETWEEN = r"(?m)^[ \t]*(?:---[ \t]*$|###[ ].*$)|(?m)(?=^[ \t]*From:)"


def _label(block: Column, name: str) -> Column:
    """The rest of a block's line that begins with a label; empty where there is none."""
    return F.trim(F.regexp_extract(block, rf"(?m)^[ \t]*{name}:[ \t]*(.*)$", 1))


def transcripts(rows: DataFrame, column: str = "text") -> DataFrame:
    """Messages of chat transcripts, one row each: blocks with ``From:``, ``Message_ts:`` and ``Text:`` lines. A transcript may be the ``results`` of a JSON object.

    An author is the ID in brackets, else the first word of the name; messages without a time are known by how they begin.
    """
    text = F.when(F.ltrim(column).startswith("{"), F.coalesce(F.get_json_object(column, "$.results"), F.col(column))).otherwise(F.col(column))
    blocks = rows.select(F.explode(F.split(F.regexp_replace(text, "\r\n?", "\n"), _BETWEEN)).alias("block"))
    who, when = _label(F.col("block"), "From"), _label(F.col("block"), "Message_ts")
    said = F.regexp_extract("block", r"(?s)^(?:.*\n)?[ \t]*Text:(.*)$", 1)
    body = F.regexp_replace(F.regexp_replace(said, r"(?m)^[ \t]*Message_ts:.*\n?", ""), r"^\s+|\s+$", "")
    ident, first, shown = F.trim(F.regexp_extract(who, r"\(ID:([^)]*)", 1)), F.regexp_extract(who, r"^(\S*)", 1), F.trim(F.regexp_extract(who, r"^([^<]*)", 1))
    author = F.when(ident != "", ident).otherwise(first)
    key = F.concat(F.lit("slack:"), F.when(when != "", when).otherwise(F.substring(body, 1, 80)))
    found = blocks.select(key.alias("source_key"), author.alias("author"), F.when(shown != "", shown).otherwise(author).alias("display"), F.lit("slack").alias("register"), body.alias("body"))
    return found.where("author <> '' and body <> ''")


def _objects(value) -> Iterator[dict]:
    """Every object inside a JSON value, the outer ones first; no recursion, so depth doesn't matter."""
    waiting = deque([value])
    while waiting:
        now = waiting.popleft()
        if isinstance(now, dict):
            yield now
            waiting.extend(now.values())
        elif isinstance(now, list):
            waiting.extend(now)


def _comment(thing: dict) -> tuple | None:
    """A message of an object that has a body and someone's login. It is known by its page, its address, its id, or how it begins."""
    body, by = thing.get("body"), thing["user"] if "user" in thing else thing.get("author")
    login = by.get("login") if isinstance(by, dict) else None
    if not isinstance(login, str) or not isinstance(body, str) or not body.strip():
        return None
    page = thing["html_url"] if "html_url" in thing else thing.get("url")
    if not isinstance(page, str):
        page = "gh:" + (json.dumps(thing["id"]) if "id" in thing else body[:80])
    return page, login, login, "pr", body


def _parsed(text: str):
    """A JSON text's value; where that is a string, or an object's ``stdout``, what it holds in turn. None for what is no JSON."""
    try:
        value = json.loads(text)
        while isinstance(inner := value.get("stdout") if isinstance(value, dict) else value, str):
            value = json.loads(inner.strip())
        return value
    except (ValueError, RecursionError):
        return None


def comments(rows: DataFrame, column: str = "json") -> DataFrame:
    """Messages of JSON texts: objects with a body and a login at any depth."""
    names = [c.split(" ")[0] for c in MESSAGE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [m for t in batch.column(0).drop_null().to_pylist() for x in _objects(_parsed(t)) if (m := _comment(x))]
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in found], pa.string()) for i in range(len(names))], names=names)

    return rows.select(column).mapInArrow(run, MESSAGE)


def repositories(root: str, depth: int = DEPTH) -> list[str]:
    """Repositories under a folder, breadth first; a repository is not searched further, hidden folders never."""
    found, level = [], [root]
    for _ in range(depth + 1):
        below = []
        for folder in level:
            if os.path.isdir(os.path.join(folder, ".git")):
                found.append(folder)
                continue
            try:
                below += sorted(e.path for e in os.scandir(folder) if e.is_dir(follow_symlinks=False) and not e.name.startswith("."))
            except OSError:
                continue
        level = below
    return found


def markdown(spark: SparkSession, repository: str) -> DataFrame:
    """``path, text`` of a repository's Markdown files: the first by path, each cut after so many bytes (a character that is cut there goes)."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(repository, wholetext=True)
    rows = files.select(F.regexp_replace(F.input_file_name(), f"^.*?{os.path.basename(repository)}/", "").alias("path"), F.when(F.octet_length("value") <= BYTES_PER_FILE, F.col("value")).otherwise(F.regexp_replace(F.decode(F.substring(F.encode("value", "UTF-8"), 1, BYTES_PER_FILE), "UTF-8"), "\ufffd$", "")).alias("text"))
    near = (F.size(F.split("path", "/")) <= DEPTH + 1) & ~F.exists(F.split("path", "/"), lambda p: p.isin(*SKIPPED_FOLDERS))
    return rows.where(near).orderBy("path").limit(FILES_PER_REPOSITORY)


def manifest_terms(files: DataFrame) -> DataFrame:
    """``term`` from ``path, text`` of Cargo.toml, Gemfile and package.json files."""
    name = F.element_at(F.split("path", "/"), -1)
    sections = F.regexp_extract_all("text", F.lit(r"(?m)^\s*\[([^\]]*dependencies[^\]]*)\]\s*\n((?:(?!\s*\[).*\n?)*)"), F.lit(2))
    cargo = F.flatten(F.transform(sections, lambda s: F.regexp_extract_all(s, F.lit(r'(?m)^\s*"?([^#"=\s.][^"=\s.]*)"?\s*='), F.lit(1))))
    gems = F.regexp_extract_all("text", F.lit(r"""(?m)^\s*gem\s+["']([^"']+)["']"""), F.lit(1))
    keys = [F.coalesce(F.json_object_keys(F.get_json_object("text", f"$.{k}")), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies", "peerDependencies")]
    packages = F.transform(F.concat(*keys), lambda k: F.regexp_replace(k, "^@+", ""))
    found = F.when(name == "Cargo.toml", cargo).when(name == "Gemfile", gems).when(name == "package.json", packages)
    return files.select(F.explode(found).alias("term")).distinct()


def remote_terms(config_lines: DataFrame, column: str = "line") -> DataFrame:
    """``term`` from ``url = `` lines of a repository's configuration: the last two path segments, unless they hold a dot."""
    url = F.regexp_extract(F.trim(column), r"^url = (.*)$", 1)
    parts = F.filter(F.split(F.regexp_replace(url, r"\.git$", ""), "[/:]"), lambda p: p != "")
    last = F.filter(F.slice(F.reverse(parts), 1, 2), lambda p: ~p.contains("."))
    return config_lines.where(url != "").select(F.explode(last).alias("term")).distinct()


def dictionary(spark: SparkSession, path: str, most: int = 60) -> DataFrame:
    """``word, level`` from a tab-separated list, levels beyond ``most`` left out; the lowest level of a word counts."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema="word string, level int")
    return rows.where((F.col("level") <= most) & F.col("word").isNotNull()).groupBy("word").agg(F.min("level").alias("level"))


def cues(spark: SparkSession, path: str) -> DataFrame:
    """``position, cue, word, margin`` from a tab-separated table."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema="position string, cue string, word string, margin double")
    return rows.where(F.col("position").isin("before", "after") & F.col("word").isNotNull()).fillna({"margin": 150.0})
