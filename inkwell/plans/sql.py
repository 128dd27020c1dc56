"""Building blocks of the SQL that mirrors the queries: the same patterns and arithmetic, in one place."""

from __future__ import annotations

LEXICAL = "^[A-Za-z''-]*[A-Za-z][A-Za-z''-]*$"
_SIGNS = r"""[^!"#$%&()*+\-/:;<=>?@\[\\\]^_`{|}~]"""
_FOLD = ("\u2019\u02bc\u2018\u201c\u201d\u2013\u2014\u00a0", "'''\"\"-- ".replace("'", "''"))
_IRI = r"""(?:[A-Za-z][A-Za-z0-9+.\-]*://[^\s<>"]+|www\.[^\s<>"]+|(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+(?:com|org|net|edu|gov|io|dev|app|info|co|ai|me|uk|de|fr|es)\b(?:[/:?#][^\s<>"]*)?)"""


def fold(x: str) -> str:
    return f"translate({x}, '{_FOLD[0]}', '{_FOLD[1]}')"


def mask(x: str) -> str:
    out = f"regexp_replace({x}, '\\S*@\\S*', ' ', 'g')"
    out = f"regexp_replace({out}, '{_IRI}', ' ', 'g')"
    out = f"regexp_replace({out}, '`[^`]*`', ' ', 'g')"
    out = f"regexp_replace({out}, '</?[A-Za-z][^>\\s]*>', ' ', 'g')"
    out = f"""regexp_replace({out}, '(^|[\\s(><"''=\\[{{:,|`])/\\S*', '\\1 ', 'g')"""
    return f"regexp_replace({out}, '(~/|\\./)\\S*', ' ', 'g')"


def tokens(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_''-]+'), lambda w: regexp_replace(w, '^[-''_]+|[-''_]+$', '', 'g')), lambda w: w <> '')"


def normalise(x: str) -> str:
    return f"regexp_replace(lower({x}), '''s$', '')"


def lexical(x: str) -> str:
    return f"(length({x}) >= 2 AND regexp_matches({x}, '{LEXICAL}'))"


def prose(x: str) -> str:
    t = f"trim(translate({x}, chr(9) || chr(13) || chr(11) || chr(12), '    '))"
    return f"({t} <> '' AND NOT starts_with({x}, '    ') AND NOT starts_with({x}, chr(9)) AND NOT regexp_matches({t}, '^(```|[$>|])') AND length(regexp_replace({t}, '[^A-Za-z]', '', 'g')) > length(regexp_replace({t}, '{_SIGNS}', '', 'g')))"


def syllables(x: str) -> str:
    n = f"len(regexp_extract_all({x}, '[aeiouy]+'))"
    return f"greatest({n} - CASE WHEN {n} > 1 AND regexp_matches({x}, 'e$') AND NOT regexp_matches({x}, '[^aeiouy]le$') THEN 1 ELSE 0 END, 1)"


def sentences(x: str) -> str:
    return f"regexp_extract_all({x}, '(?s)[^\\p{{L}}\\p{{N}}]*[\\p{{L}}\\p{{N}}][^.!?]*[.!?]?')"


def rounded(x: str, places: int) -> str:
    f = f"{float(10**places)}"
    return f"(sign({x}) * floor(abs({x}) * {f} + 0.5) / {f})"


def lines(table: str = "documents", keys: str = "doc_id, source, lang", text: str = "text") -> str:
    split = f"string_split(coalesce({text}, ''), chr(10))"
    return f"lines AS (SELECT {keys}, line, regexp_replace(l, chr(13) || '$', '') AS raw FROM (SELECT {keys}, unnest({split}) AS l, generate_subscripts({split}, 1) AS line FROM {table}))"


def prose_words(table: str = "documents", keys: str = "doc_id, source, lang", text: str = "text") -> str:
    """CTEs ``lines``, ``prose_lines`` (with ``masked``), ``line_words`` (with ``ws``) and ``words`` (lexical ones)."""
    masked = mask(fold("raw"))
    ws = f"list_filter(list_transform({tokens('masked')}, lambda w: {normalise('w')}), lambda w: length(w) >= 2)"
    return f"""{lines(table, keys, text)},
prose_lines AS MATERIALIZED (SELECT {keys}, line, raw, {masked} AS masked FROM lines WHERE {prose("raw")}),
line_words AS MATERIALIZED (SELECT {keys}, line, raw, {ws} AS ws FROM prose_lines),
words AS MATERIALIZED (SELECT {keys}, line, word FROM (SELECT {keys}, line, unnest(ws) AS word FROM line_words) WHERE {lexical("word")})"""


def runs(keys: str = "doc_id, source, lang") -> str:
    """After :func:`prose_words`: ``runs`` with ``run`` and its ``ws``."""
    marked = f"string_split(array_to_string(list_transform(ws, lambda w: CASE WHEN {lexical('w')} THEN w ELSE chr(10) END), ' '), chr(10))"
    return f"""runs AS MATERIALIZED (SELECT {keys}, line, run, string_split(r, ' ') AS ws FROM (SELECT {keys}, line, unnest(rs) AS r, generate_subscripts(rs, 1) - 1 AS run FROM
 (SELECT {keys}, line, list_filter(list_transform({marked}, lambda x: trim(x)), lambda x: x <> '') AS rs FROM line_words)))"""


def grams(n: int, keys: str) -> str:
    joined = " || ' ' || ".join(f"ws[i + {k}]" for k in range(n))
    return f"SELECT {keys}, unnest(list_transform(range(1, greatest(len(ws) - {n - 2}, 1)::BIGINT), lambda i: {joined})) AS gram FROM runs"


def log_likelihood(k11: str, k12: str, k21: str, k22: str) -> str:
    n = f"({k11} + {k12} + {k21} + {k22})"

    def term(k: str, row: str, col: str) -> str:
        return f"(CASE WHEN {k} > 0 AND ({row}) * ({col}) / {n} > 0 THEN {k} * ln({k} / (({row}) * ({col}) / {n})) ELSE 0 END)"

    return f"2.0 * ({term(k11, f'{k11} + {k12}', f'{k11} + {k21}')} + {term(k12, f'{k11} + {k12}', f'{k12} + {k22}')} + {term(k21, f'{k21} + {k22}', f'{k11} + {k21}')} + {term(k22, f'{k21} + {k22}', f'{k12} + {k22}')})"


def dictionary(least: int = 3) -> str:
    """After :func:`prose_words`: ``dict`` with ``word, level`` from document counts."""
    return f"""dict AS MATERIALIZED (SELECT word, CASE WHEN docs >= 200 THEN 10 WHEN docs >= 60 THEN 20 WHEN docs >= 20 THEN 35 WHEN docs >= 10 THEN 40 WHEN docs >= 6 THEN 50 WHEN docs >= 4 THEN 55 ELSE 60 END AS level
 FROM (SELECT word, count(DISTINCT doc_id) AS docs FROM words GROUP BY word) WHERE docs >= {least})"""


def one_less(x: str) -> str:
    """The word and all spellings with one character gone."""
    return f"list_concat([{x}], list_transform(range(1, length({x})::BIGINT + 1), lambda i: left({x}, i - 1) || substr({x}, i + 1)))"


def osa_upto_2(a: str, b: str) -> str:
    """The restricted distance of two ASCII words, 3 for all above 2.

    DuckDB's distance lets letters change between swapped ones, which can only make a 3 a 2. A restricted 2 has either no swap, or a swap with one slip at most before or after it.
    """
    slips = f"damerau_levenshtein(left({a}, i - 1), left({b}, greatest(i + d - 1, 0))) + damerau_levenshtein(substr({a}, i + 2), substr({b}, greatest(i + d, 1) + 2))"
    swap = f"list_filter(range(1, length({a})::BIGINT), lambda i: len(list_filter([-1, 0, 1], lambda d: i + d >= 1 AND substr({b}, greatest(i + d, 1), 2) = reverse(substr({a}, i, 2)) AND {slips} <= 1)) > 0)"
    return f"CASE WHEN damerau_levenshtein({a}, {b}) <> 2 THEN least(damerau_levenshtein({a}, {b}), 3) WHEN levenshtein({a}, {b}) = 2 OR len({swap}) > 0 THEN 2 ELSE 3 END"


def common_prefix(a: str, b: str) -> str:
    return f"len(list_filter(range(1, least(length({a}), length({b}))::BIGINT + 1), lambda i: left({a}, i) = left({b}, i)))"


def blanked(x: str, pattern: str, start: str = "0") -> str:
    """The text with every match as spaces, from ``start`` (an expression over the match ``h``) on."""
    pieces = f"list_zip(string_split_regex({x}, '{pattern}'), regexp_extract_all({x}, '{pattern}'))"
    hit = f"list_transform([coalesce(z[2], '')], lambda h: left(h, {start}) || repeat(' ', length(h) - {start}))[1]"
    return f"array_to_string(list_transform({pieces}, lambda z: coalesce(z[1], '') || {hit}), '')"


def mask_in_place(x: str) -> str:
    """The text with all that is no prose as spaces; a path begins at the first slash of a run that nothing but an opening sign precedes, or at the first ``~/`` or ``./``."""
    rooted = "regexp_extract(h, '^(?:|.*?[(><\"''=\\[{:,|`])/')"
    marked = "regexp_extract(h, '^.*?(?:~/|\\./)')"
    start = f"least(CASE WHEN {rooted} = '' THEN length(h) ELSE length({rooted}) - 1 END, CASE WHEN {marked} = '' THEN length(h) ELSE length({marked}) - 2 END)::BIGINT"
    regions = [blanked(x, "`[^`]*`"), blanked(x, "</?[A-Za-z][^>\\s]*>"), blanked(x, "\\S+", start), blanked(x, "\\S*@\\S*"), blanked(x, _IRI.replace("'", "''"))]
    return "[" + ", ".join(regions) + "]"


def union_of_spaces(x: str, versions: str) -> str:
    at = "list_transform(range(1, length({0})::BIGINT + 1), lambda i: CASE WHEN len(list_filter({1}, lambda v: substr(v, i, 1) = ' ')) > 0 THEN ' ' ELSE substr({0}, i, 1) END)"
    return f"array_to_string({at.format(x, versions)}, '')"
