"""Who wrote a text: assistant markers, trailers, injected envelopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import ENVELOPES, MARKERS


def undecorate(line: Column) -> Column:
    """A line without leading decoration, link targets and emphasis, in lower case."""
    bare = F.regexp_replace(line, r"^[^\p{IsAlphabetic}\p{N}]+", "")
    bare = F.regexp_replace(bare, r"\([^)]*(\)|$)", "")
    return F.trim(F.lower(F.regexp_replace(bare, r"[\[\]*_`]", "")))


def marks(line: Column) -> Column:
    """Whether a line opens with a marker."""
    return undecorate(line).rlike("^(" + "|".join(m.replace("-", "\\-") for m in MARKERS) + ")")


def marker(body: Column) -> Column:
    """The first marker in a text, else null."""
    found = F.filter(F.transform(F.split(body, "\n"), lambda x: F.coalesce(*[F.when(undecorate(x).startswith(m), F.lit(m)) for m in MARKERS])), lambda m: m.isNotNull())
    return F.get(found, 0)


def is_assistant(body: Column) -> Column:
    return F.exists(F.split(body, "\n"), marks)


def strip_trailer(body: Column) -> Column:
    """The text before its first marker line, without trailing white space; a text without one stays as it is."""
    lines = F.split(body, "\n")
    at = F.array_position(F.transform(lines, marks), True)
    return F.when(at > 0, F.regexp_replace(F.array_join(F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")), "\n"), r"\s+$", "")).otherwise(body)


def strip_envelopes(prompt: Column) -> Column:
    """A prompt without the blocks that tools put in; an unclosed block runs to the end."""
    for tag in ENVELOPES:
        prompt = F.regexp_replace(prompt, f"(?s)<{tag}>.*?(</{tag}>|$)", " ")
    return F.regexp_replace(prompt, r"^\s+|\s+$", "")


def typed_prompt(prompt: Column) -> Column:
    """What the user typed, or null for nothing and for slash commands."""
    text = strip_envelopes(prompt)
    return F.when((text != "") & ~text.startswith("/"), text)
