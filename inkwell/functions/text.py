"""Text functions as Column expressions: folding, tokens, predicates, sentences, syllables, identifiers.

Everything here stays inside the JVM. Patterns are written so that an RE2 engine reads them alike, apart from the Unicode class of letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lets import let

TOKEN = r"[\p{IsAlphabetic}\p{N}_'-]+"
LEXICAL = r"^['-]*[A-Za-z][A-Za-z'-]*$"
#: The core of a run of word characters: from its first letter or digit to its last.
CORE = r"[\p{IsAlphabetic}\p{N}](?:[\p{IsAlphabetic}\p{N}_'-]*[\p{IsAlphabetic}\p{N}])?"
#: ASCII punctuation but for apostrophe, full stop and comma.
SIGNS = r"""[!"#$%&()*+\-/:;<=>?@\[\\\]^_`{|}~]"""


def fold_typography(text: Column) -> Column:
    """Curly quotes, dashes and no-break spaces as their plain forms, one character for one."""
    marked = (F.octet_length(text) != F.length(text)) & text.rlike("[\u00a0\u02bc\u2013-\u201d]")
    return F.when(marked, F.translate(text, "\u2019\u02bc\u2018\u201c\u201d\u2013\u2014\u00a0", "'''\"\"-- ")).otherwise(text)


def raw_tokens(line: Column) -> Column:
    """Runs of word characters as they stand."""
    return F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0))


def trim_token(token: Column) -> Column:
    return F.regexp_replace(token, r"^[-'_]+|[-'_]+$", "")


def tokens(line: Column) -> Column:
    """Words of a line, without outer hyphens, apostrophes and underscores."""
    return F.regexp_extract_all(line, F.lit(CORE), F.lit(0))


def normalise(token: Column) -> Column:
    """Lower case, without one possessive ending."""
    return let(F.lower(token), lambda x: F.when(x.endswith("'s"), F.substring(x, F.lit(1), F.length(x) - 2)).otherwise(x))


def is_lexical(word: Column) -> Column:
    return (F.length(word) >= 2) & word.rlike(LEXICAL)


def is_checkable(token: Column) -> Column:
    """Plain words of three letters or more: no digits, acronyms, acronym plurals or camel case."""
    letters = F.regexp_replace(token, "[^A-Za-z]", "")
    return (F.length(token) >= 3) & token.rlike("^[A-Za-z'-]+$") & letters.rlike("[a-z]") & ~letters.rlike("^[A-Z]{2,}s$") & ~letters.rlike("[a-z][A-Z]")


def starts_upper(token: Column) -> Column:
    return token.rlike("^[A-Z]")


def is_prose(line: Column) -> Column:
    """Whether a line reads as prose: not indented, no fence, prompt, quote or table, more letters than signs."""
    # a line with more letters than signs isn't blank
    shape = ~line.rlike("^(    |\t)") & ~line.rlike(r"^[ \t\r\x0b\x0c]*(```|[$>|])")
    return shape & (F.length(F.regexp_replace(line, "[^A-Za-z]+", "")) > F.length(F.regexp_replace(line, f"[^{SIGNS[1:]}+", "")))


def sentences(text: Column) -> Column:
    """Pieces that end at a full stop, exclamation or question mark and hold a letter or digit; a last piece without an end counts too."""
    return F.regexp_extract_all(text, F.lit(r"(?s)[^\p{IsAlphabetic}\p{N}]*[\p{IsAlphabetic}\p{N}][^.!?]*[.!?]?"), F.lit(0))


def syllables(word: Column) -> Column:
    """Vowel groups, less a silent final ``e`` (not in consonant + ``le``), at least one."""
    groups = F.regexp_count(word, F.lit("[aeiouy]+"))
    silent = (groups > 1) & word.rlike("e$") & ~word.rlike("[^aeiouy]le$")
    return F.greatest(groups - F.when(silent, 1).otherwise(0), F.lit(1))


def ngrams(words: Column, n: int) -> Column:
    """Consecutive n-grams of an array, joined by spaces."""
    made = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
    return F.when(F.size(words) >= n, let(words, made)).otherwise(F.array().cast("array<string>"))


def lexical_runs(words: Column) -> Column:
    """Maximal stretches of lexical words, as arrays."""
    marked = F.array_join(F.transform(words, lambda w: F.when(is_lexical(w), w).otherwise(F.lit("\n"))), " ")
    runs = F.filter(F.transform(F.split(marked, "\n"), lambda r: F.trim(r)), lambda r: r != "")
    return F.transform(runs, lambda r: F.split(r, " "))


def split_identifier(name: Column) -> Column:
    """Parts of an identifier: cut at ``_ - . /`` and before capitals, lower-cased, letters only, two or more."""
    cut = F.split(F.regexp_replace(name, "([A-Z])", " $1"), r"[_\-./ ]+")
    return F.filter(F.transform(cut, F.lower), lambda p: p.rlike("^[a-z]{2,}$"))


def expand_term(term: Column) -> Column:
    """A seed term and its parts, sorted and distinct."""
    clean = F.regexp_replace(F.trim(term), '^"+|"+$', "")
    whole = F.lower(clean)
    kept = F.when(whole.rlike("^[a-z0-9_-]{2,}$"), F.array(whole)).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(kept, split_identifier(clean))))


def is_subsequence(needle: Column, hay: Column) -> Column:
    """Whether all characters of one word occur in the other, in order."""
    left = F.aggregate(F.split(hay, ""), needle, lambda rest, c: F.when((rest != "") & (F.substring(rest, 1, 1) == c), F.substring(rest, 2, 1 << 20)).otherwise(rest))
    return left == ""


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    same = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))), lambda i: F.when(F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i), i).otherwise(0))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.array_max(same))


def appears_bounded(hay: Column, needle: Column) -> Column:
    """Whether a handle occurs with no handle character on either side."""
    edge = F.lit(r"[A-Za-z0-9.@_\-]")
    # a quotation's own end mark inside the handle is quoted by itself
    quoted = F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    pattern = F.concat(F.lit("(?<!"), edge, F.lit(r")\Q"), quoted, F.lit(r"\E(?!"), edge, F.lit(")"))
    return (needle != "") & F.regexp_like(hay, pattern)
