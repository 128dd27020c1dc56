"""Texts cut to words in Arrow batches: the same lines, words and runs as in :mod:`tokens`, for texts whose characters both engines class alike.

Java's patterns over every line and word took most of the time of whatever reads a corpus. Texts with other characters go the plain way, and
both parts are put together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import mask
from inkwell.functions import text as tx
from inkwell.operators import tokens
from inkwell.sources.scratch import kept

#: Characters outside Latin and the common signs; dotted capital I, whose small form is two characters; a domain's ending before a letter with
#: an accent, where Java's word boundary depends on its version.
_ODD = re.compile(r"[^\x00-\u012f\u0131-\u024f\u02bc\u2010-\u2027\u20ac]|\.(?:com|org|net|edu|gov|io|dev|app|info|co|ai|me|uk|de|fr|es)[^\x00-\x7f]")
#: Characters of text in a slice, and words in a table of counts, before they are handed on.
SLICE, WORDS_HELD = 1 << 20, 200_000

_ALL = bytes(range(256))
_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_NOT_LETTERS = bytes(set(_ALL) - set(_LETTERS))
_NOT_SIGNS = bytes(c for c in _ALL if not (c < 128 and re.match(tx.SIGNS, chr(c))))
_FOLD = tuple(zip("\u2019\u02bc\u2018\u201c\u201d\u2013\u2014\u00a0", "'''\"\"-- ", strict=True))
# two characters at least, as shorter words don't count
_CORE = re.compile(r"[^\W_][\w'-]*[^\W_]")
#: Of Latin-1: small letters, figures and joiners stay, all else is a space.
_KEPT = bytes(ord(chr(c).lower()) if chr(c).isalnum() or chr(c) in "_'-" else 32 for c in range(256))
_LEXICAL = re.compile(r"['-]*[A-Za-z][A-Za-z'-]*")
_FIGURE = re.compile("[0-9_]")
_DOTTED = re.compile(r"\.[A-Za-z]")
_SCHEME = "[A-Za-z][A-Za-z0-9+.\\-]*://[^\\s<>\"]+|"
# (what a line must hold, pattern), with ASCII classes as Java has them
_REGIONS = [(sign, re.compile(pattern, re.ASCII)) for sign, pattern in (("`", mask.CODE), ("<", mask.TAG), ("/", mask.PATH), ("@", mask.EMAIL), ("://", mask.IRI), (".", mask.IRI.replace(_SCHEME, "")))]


def is_prose(line: str) -> bool:
    if line.startswith(("    ", "\t")) or line.lstrip(" \t\r\x0b\x0c").startswith(("```", "$", ">", "|")):
        return False
    raw = line.encode()
    return len(raw.translate(None, _NOT_LETTERS)) > len(raw.translate(None, _NOT_SIGNS))


def masked(line: str) -> str:
    if not ("`" in line or "<" in line or "/" in line or "@" in line or "." in line and _DOTTED.search(line)):
        return line
    out = line
    for sign, pattern in _REGIONS:
        # with a scheme the whole pattern for web addresses has run
        if sign in line and not (sign == "." and "://" in line):
            for hit in pattern.finditer(line):
                out = f"{out[: hit.start()]}{' ' * (hit.end() - hit.start())}{out[hit.end() :]}"
    return out


def folded(line: str) -> str:
    if not line.isascii():
        for sign, simple in _FOLD:
            if sign in line:
                line = line.replace(sign, simple)
    return line


def line_words(line: str) -> list[str]:
    line = masked(folded(line))
    try:
        low = line.encode("latin-1").translate(_KEPT).decode("latin-1")
        words = low.split(" ")
        if "'" in low or "-" in low or "_" in low:
            words = [w.strip("-'_") for w in words]
    except UnicodeEncodeError:
        low = line.lower()
        words = _CORE.findall(low)
    if "'s" in low:
        words = [w[:-2] if w.endswith("'s") else w for w in words]
    return [w for w in words if len(w) >= 2]


def prose(text: str | None) -> Iterator[tuple[int, list[str]]]:
    """``line, words`` of the lines that read as prose."""
    for i, line in enumerate((text or "").split("\n"), 1):
        if is_prose(line):
            yield i, line_words(line)


@lru_cache(1 << 18)
def is_lexical(word: str) -> bool:
    return _LEXICAL.fullmatch(word) is not None


def lexical_runs(words: list[str]) -> list[list[str]]:
    # words begin with a letter or figure
    if words and (whole := "".join(words)).isascii() and not _FIGURE.search(whole):
        return [words]
    out, last = [], []
    for w in words:
        if is_lexical(w):
            if not last:
                out.append(last)
            last.append(w)
        elif last:
            last = []
    return out


def _slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Rows of about ``SLICE`` characters with their texts."""
    for batch in batches:
        texts, start, size = batch.column(text).to_pylist(), 0, 0
        for i, x in enumerate(texts, 1):
            size += len(x or "")
            if size >= SLICE or i == len(texts):
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0


def _odd(text: str | None) -> bool:
    return text is not None and not text.isascii() and _ODD.search(text) is not None


def _cut(df: DataFrame, text: str, columns: list[str], pieces: Callable[[str | None], Iterator[tuple]], plainly: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` without its text, once for each piece of the text: whole numbers named in ``columns``, then ``words``; written once, for odd texts whole."""
    rest = [c for c in df.columns if c != text]
    schema = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text), *(f"{c} int" for c in columns), "words array<string>", "odd_text string"]

    def run(batches):
        for part, texts in _slices(batches, text):
            at, numbers, sizes, flat, left = [], [], [0], [], []
            for i, x in enumerate(texts):
                for *where, words in [(*[0] * len(columns), [])] if (odd := _odd(x)) else pieces(x):
                    at.append(i)
                    numbers.append(where)
                    left.append(x if odd else None)
                    flat += words
                    sizes.append(len(flat))
            if at:
                places = pa.array(at, pa.int64())
                words = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.string()))
                made = [pa.array(c, pa.int32()) for c in zip(*numbers, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(places) for c in rest), *made, words, pa.array(left, pa.string())], names=[*rest, *columns, "words", "odd_text"])

    out = kept(df.mapInArrow(run, ", ".join(schema)), "cut-texts")
    odd = out.where("odd_text is not null").select(*rest, F.col("odd_text").alias(text))
    cut, slow = out.where("odd_text is null").drop("odd_text"), plainly(odd)
    return kept(cut.unionByName(slow), "all-texts") if odd.limit(1).count() else cut


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """``line, words`` of prose lines as :func:`tokens.prose_words` has them; the other columns stay."""
    rest = [c for c in df.columns if c != text]
    return _cut(df, text, ["line"], prose, lambda odd: tokens.prose_words(odd, text).select(*rest, "line", "words"))


def _runs(text: str | None) -> Iterator[tuple]:
    for line, words in prose(text):
        for k, run in enumerate(lexical_runs(words)):
            yield line, k, run


def runs(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of :func:`tokens.runs`."""
    return _cut(df, text, ["line", "run"], _runs, lambda odd: tokens.runs(odd, text))


def _bit(key: int) -> int:
    """Of the remainder to 30, which has the sign of the key."""
    return 1 << ((key % 30 if key >= 0 else -(-key % 30)) + 29)


def by_document(words: DataFrame, key: str = "doc_id") -> DataFrame:
    """``word, docs, n, first, bits`` for each word and document of a frame of words."""
    rows = words.groupBy("word", key).agg(F.count(F.lit(1)).alias("n"))
    bits = F.expr(f"coalesce(shiftleft(1L, cast({key} % 30 + 29 AS int)), 0L)")
    return rows.select("word", F.col(key).isNotNull().cast("long").alias("docs"), "n", F.col(key).cast("long").alias("first"), bits.alias("bits"))


def summed(parts: DataFrame) -> DataFrame:
    """``word, docs, n, first, days`` from parts that share no document: a row for each word."""
    sums = parts.groupBy("word").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.min("first").alias("first"), F.bit_or("bits").alias("bits"))
    return sums.select("word", "docs", "n", "first", F.bit_count("bits").cast("long").alias("days"))


def vocabulary(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, docs, n, first, days`` of texts. Counts of batches add up where each row is a document of its own, which is looked up first."""
    df = df.select(key, text)
    if df.groupBy(key).agg(F.count(F.lit(1)).alias("c")).where((F.col("c") > 1) | F.col(key).isNull()).limit(1).count():
        return summed(by_document(tokens.words(df, text), key))
    names = ("word", "docs", "n", "first", "bits", "odd_text")

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def run(batches):
        table: dict[str, list[int]] = {}
        for part, texts in _slices(batches, text):
            for k, x in zip(part.column(key).to_pylist(), texts, strict=True):
                if _odd(x):
                    yield batch([(None, None, None, k, None, x)])
                    continue
                bit = _bit(k)
                for w, n in Counter([w for _, words in prose(x) for w in words]).items():
                    if (e := table.get(w)) is None:
                        table[w] = [1, n, k, bit]
                    else:
                        e[0] += 1
                        e[1] += n
                        e[3] |= bit
                        if k < e[2]:
                            e[2] = k
            if len(table) >= WORDS_HELD:
                yield batch([(w, *e, None) for w, e in table.items() if is_lexical(w)])
                table = {}
        yield batch([(w, *e, None) for w, e in table.items() if is_lexical(w)])

    out = kept(df.mapInArrow(run, "word string, docs long, n long, first long, bits long, odd_text string"), "tallies")
    odd = out.where("odd_text is not null").select(F.col("first").alias(key), F.col("odd_text").alias(text))
    return summed(out.where("odd_text is null").drop("odd_text").unionByName(by_document(tokens.words(odd, text), key)))
