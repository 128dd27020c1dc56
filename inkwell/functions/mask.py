"""Blanking what isn't prose: code spans, tags, paths, e-mail addresses, web addresses.

Every kind of region is found on the line as it came and blanked with as many spaces; the result is the union of all. Lines without any
marker character skip the work.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lets import let

CODE = r"`[^`]*`"
TAG = r"</?[A-Za-z][^>\s]*>"
PATH = r"""(?:(?<![^\s(><"'=\[{:,|`])/|~/|\./)\S*"""
EMAIL = r"\S*@\S*"
#: Web addresses: a scheme, ``www.``, or a bare domain with a common ending.
IRI = r"""(?:[A-Za-z][A-Za-z0-9+.\-]*://[^\s<>"]+|www\.[^\s<>"]+|(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+(?:com|org|net|edu|gov|io|dev|app|info|co|ai|me|uk|de|fr|es)\b(?:[/:?#][^\s<>"]*)?)"""
REGIONS = (CODE, TAG, PATH, EMAIL, IRI)
MARKER = r"[`</@]|\.[A-Za-z]"


def blank(line: Column, pattern: str) -> Column:
    """The line with every match of ``pattern`` as spaces."""
    parts, hits = F.split(line, pattern, -1), F.regexp_extract_all(line, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(parts, hits, lambda p, h: F.concat(F.coalesce(p, F.lit("")), F.repeat(F.lit(" "), F.length(F.coalesce(h, F.lit("")))))), "")


def _union(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.when((x == " ") | (y == " "), " ").otherwise(x))


def mask(line: Column, regions: tuple[str, ...] = REGIONS) -> Column:
    """The line with all regions blank; its length stays."""

    def masked(one: Column) -> Column:
        # only kinds that occur are cut to characters
        found = reduce(lambda acc, r: F.when(one.rlike(r), _union(acc, F.split(blank(one, r), ""))).otherwise(acc), regions, F.split(one, ""))
        return F.array_join(found, "")

    return let(line, lambda x: F.when(x.rlike(MARKER), masked(x)).otherwise(x))


def removed(line: Column, masked: Column) -> Column:
    """What masking took away, in place; the rest as spaces."""
    return F.array_join(F.zip_with(F.split(line, ""), F.split(masked, ""), lambda a, m: F.when(m == " ", a).otherwise(" ")), "")
