"""Queries over the lexicon and the checker."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import dims
from inkwell.functions.lets import merged, posexplode, round_half_away
from inkwell.operators import cutting, evaluate, findings, hooks, ingest, known, maintain, phrases, realword, seed, suggest, tokens, vocabulary
from inkwell.plans import checker_sql, sql
from inkwell.plans.text_queries import RUNS, WORDS, documents, read
from inkwell.sources.scratch import kept

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


DICT = sql.dictionary()


def words_of(spark, sf_dir):
    return tokens.words(documents(spark, sf_dir))


def lined(spark, sf_dir):
    """Prose lines with their words, written once for all that a query makes of them."""
    return cutting.lines(documents(spark, sf_dir).select("doc_id", "source", "text"))


def counted(words):
    """``word, docs, n, first, days``: a row for each word, written once; what queries know of the vocabulary comes from it."""
    return kept(cutting.summed(cutting.by_document(words)), "vocabulary")


def vocabulary_of(spark, sf_dir):
    return kept(cutting.vocabulary(documents(spark, sf_dir)), "vocabulary")


def dictionary(spark, sf_dir):
    return vocabulary.dictionary_from(words_of(spark, sf_dir))


@query("word_sources", f"WITH {WORDS} SELECT word, count(DISTINCT doc_id) AS sources FROM words GROUP BY word")
def word_sources(spark, sf_dir):
    return vocabulary.document_counts(vocabulary.word_sources(words_of(spark, sf_dir)))


@query("day_corroboration", "SELECT event_type || '-' || user_id AS word, count(DISTINCT ts::DATE) AS days FROM events GROUP BY 1")
def day_corroboration(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("word"), "event_id", "ts")
    return vocabulary.day_counts(vocabulary.word_sources(rows, "event_id", "ts"))


#: Name columns of the driver's tables that stand for term sources, by provenance.
SEEDS = (("region", "r_name", "user"), ("nation", "n_name", "owned"), ("supplier", "s_name", "tap"), ("customer", "c_name", "installed"), ("part", "p_name", "dependency"))
_TERMS = " UNION ALL ".join(f"SELECT {c} AS term, '{p}' AS provenance, '{t}' AS source, {dims.RANK[p]} AS r FROM {t}" for t, c, p in SEEDS)
_CLEAN = "regexp_replace(trim(term), '^\"+|\"+$', '', 'g')"
_PARTS = f"list_filter(list_transform(regexp_split_to_array(regexp_replace({_CLEAN}, '([A-Z])', ' \\1', 'g'), '[_\\-./ ]+'), lambda p: lower(p)), lambda p: regexp_matches(p, '^[a-z]{{2,}}$'))"
_EXPANDED = f"expanded AS MATERIALIZED (SELECT DISTINCT unnest(list_concat(CASE WHEN regexp_matches(lower({_CLEAN}), '^[a-z0-9_-]{{2,}}$') THEN [lower({_CLEAN})] ELSE [] END, {_PARTS})) AS word, provenance, source, r FROM ({_TERMS}))"
_NAMES = "['" + "','".join(n for n, _ in dims.PROVENANCE) + "']"
_PRIORS = "[" + ",".join(f"{p}::DOUBLE" for _, p in dims.PROVENANCE) + "]"


def terms(spark, sf_dir):
    rows = None
    for table, column, provenance in SEEDS:
        part = read(spark, sf_dir, table).select(F.col(column).alias("term"), F.lit(provenance).alias("provenance"), F.lit(table).alias("source"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query("expand_terms", f"WITH {_EXPANDED} SELECT source, provenance, count(DISTINCT word) AS terms FROM expanded GROUP BY source, provenance")
def expand_terms(spark, sf_dir):
    return seed.source_report(terms(spark, sf_dir))


_SEEDED = "seeded AS MATERIALIZED (SELECT word, max(r) AS r FROM expanded GROUP BY word)"


@query("seed_merge", f"WITH {_EXPANDED}, {_SEEDED} SELECT word, {_NAMES}[r + 1] AS provenance, 0::BIGINT AS count FROM seeded")
def seed_merge(spark, sf_dir):
    return seed.merged(terms(spark, sf_dir)).select("word", "provenance", "count")


_OBSERVED = "observed AS MATERIALIZED (SELECT word, count(*) AS c, count(DISTINCT doc_id) AS sources FROM words GROUP BY word)"
_LEXICON = f"{WORDS}, {_EXPANDED}, {_SEEDED}, {_OBSERVED}, lexicon AS MATERIALIZED (SELECT coalesce(s.word, o.word) AS word, coalesce(s.r, 0) AS r, coalesce(c, 0) AS count, coalesce(sources, 0) AS sources, s.word IS NULL AS is_new, coalesce(s.r < 0, false) AS upgraded FROM seeded s FULL JOIN observed o USING (word))"


def lexicon(spark, sf_dir, known_of=None):
    words = known_of or vocabulary_of(spark, sf_dir)
    observed = words.select("word", F.col("word").alias("display"), F.lit("observed").alias("provenance"), F.col("n").alias("increment"), F.col("first").alias("seq"))
    return vocabulary.merge(seed.merged(terms(spark, sf_dir)), vocabulary.upsert(observed))


@query("provenance_ratchet", f"WITH {_LEXICON} SELECT word, {_NAMES}[r + 1] AS provenance, count, is_new, upgraded FROM lexicon")
def provenance_ratchet(spark, sf_dir):
    return lexicon(spark, sf_dir).select("word", "provenance", "count", "is_new", "upgraded")


_VALID = f"least({_PRIORS}[r + 1] + (1 - {_PRIORS}[r + 1]) * (sources / (sources + 2.0::DOUBLE)) * 0.5::DOUBLE, 1.0::DOUBLE)"
_ENTRIES = f"{_LEXICON}, {DICT}, entries AS (SELECT l.word, {_NAMES}[r + 1] AS provenance, count, sources, {sql.rounded(_VALID, 6)} AS validity, CASE WHEN d.word IS NOT NULL OR r IN (0, 5) THEN 'word' ELSE 'name' END AS kind FROM lexicon l LEFT JOIN dict d ON l.word = d.word)"


def entries(spark, sf_dir, known_of=None, **options):
    words = known_of or vocabulary_of(spark, sf_dir)
    out = vocabulary.listing(lexicon(spark, sf_dir, words), words.select("word", F.col("docs").alias("sources")), vocabulary.levelled(words), **options)
    return out.withColumn("validity", round_half_away(F.col("validity"), 6))


@query("lexicon_validity", f"WITH {_ENTRIES} SELECT word, provenance, count, sources, validity, kind FROM entries")
def lexicon_validity(spark, sf_dir):
    return entries(spark, sf_dir)


@query("lexicon_list_filter", f"WITH {_ENTRIES} SELECT word, provenance, count, sources, validity, kind FROM entries WHERE word ILIKE '%an%' ORDER BY count DESC, word LIMIT 50")
def lexicon_list_filter(spark, sf_dir):
    return entries(spark, sf_dir, needle="an", limit=50)


@query("dictionary_levels", f"WITH {WORDS}, {DICT} SELECT word, level FROM dict")
def dictionary_levels(spark, sf_dir):
    return dictionary(spark, sf_dir)


_RANKED = "ranked AS (SELECT word, row_number() OVER (ORDER BY level, word) - 1 AS rank FROM dict)"
_MINED = "mined AS (SELECT word, count(*) AS c FROM (SELECT unnest(ws) AS word FROM line_words) WHERE regexp_matches(word, '^[A-Za-z'']*[A-Za-z][A-Za-z'']*$') GROUP BY word)"


@query("frequency_merge", f"WITH {WORDS}, {DICT}, {_RANKED}, {_MINED}, f AS (SELECT word, (1000000 // (rank + 1))::BIGINT AS c FROM ranked WHERE rank < 300 UNION ALL SELECT word, c FROM mined) SELECT word, sum(c)::BIGINT AS count FROM f GROUP BY word")
def frequency_merge(spark, sf_dir):
    words = vocabulary_of(spark, sf_dir)
    best = vocabulary.levelled(words).orderBy("level", "word").limit(300)
    ranked = best.selectExpr("word", "row_number() over (order by level, word) - 1 as rank")
    return seed.totals(seed.frequencies(seed.core_counts(ranked), seed.minable(words).select("word", F.col("n").alias("count"))))


# A part of the vocabulary stands for each of the checker's tables: by its last letter, so that all of them differ.
_TABLES = f"{WORDS}, {DICT}, trusted AS (SELECT DISTINCT word FROM words WHERE word LIKE '%g'), seen AS (SELECT word, count(DISTINCT doc_id % 30) AS days FROM words WHERE word LIKE '%s' GROUP BY word), freq AS (SELECT word, count(*) AS c FROM words WHERE word LIKE '%n' GROUP BY word)"
_ASKED = "asked AS MATERIALIZED (SELECT DISTINCT word FROM words)"
_ATOMS = """standing AS MATERIALIZED (SELECT a.word, level, t.word IS NOT NULL AS trusted, coalesce(days, 0) AS days, CASE WHEN coalesce(c, 0) > 0 THEN c WHEN t.word IS NOT NULL THEN greatest(coalesce((70 - level) // 10, 0), 3) ELSE coalesce((70 - level) // 10, 0) END AS f
 FROM (SELECT word FROM asked UNION SELECT unnest(string_split(word, '-')) FROM asked WHERE contains(word, '-')) a LEFT JOIN dict d ON a.word = d.word LEFT JOIN trusted t ON a.word = t.word LEFT JOIN seen s ON a.word = s.word LEFT JOIN freq q ON a.word = q.word),
unsure AS (SELECT word FROM standing WHERE days = 2 AND NOT trusted AND length(word) >= 4),
near_common AS (SELECT DISTINCT u.word FROM unsure u, (SELECT word AS w FROM dict WHERE level <= 35) c WHERE abs(length(u.word) - length(w)) <= 1 AND (
 (u.word <> w AND damerau_levenshtein(u.word, w) = 1 AND (length(w) < length(u.word) OR regexp_matches(translate(w, u.word, ''), '^[a-z]*$') )) OR (u.word = w AND regexp_matches(u.word, 'aa|bb|cc|dd|ee|ff|gg|hh|ii|jj|kk|ll|mm|nn|oo|pp|qq|rr|ss|tt|uu|vv|ww|xx|yy|zz')))),
atoms AS MATERIALIZED (SELECT s.word, trusted OR days >= CASE WHEN n.word IS NULL THEN 2 ELSE 3 END OR f >= 2 OR level IS NOT NULL AS ok FROM standing s LEFT JOIN near_common n ON s.word = n.word),
known_words AS MATERIALIZED (SELECT a.word, coalesce(x.ok, false) OR coalesce(p.ok, false) AS known FROM asked a LEFT JOIN atoms x ON a.word = x.word LEFT JOIN
 (SELECT q.word, bool_and(length(part) < 3 OR coalesce(y.ok, false)) AS ok FROM (SELECT word, unnest(string_split(word, '-')) AS part FROM asked WHERE contains(word, '-')) q LEFT JOIN atoms y ON q.part = y.word WHERE part <> '' GROUP BY q.word) p ON a.word = p.word)"""


def tables(spark, words):
    return known.tables(
        spark,
        dictionary=vocabulary.levelled(words),
        lexicon=words.where("word like '%g'").select("word"),
        observed=words.where("word like '%s'").select("word", "days"),
        frequency=words.where("word like '%n'").select("word", F.col("n").alias("count")),
    )


@query("known_words", f"WITH {_TABLES}, {_ASKED}, {_ATOMS} SELECT word, known FROM known_words")
def known_words(spark, sf_dir):
    words = vocabulary_of(spark, sf_dir)
    return known.knows(words, tables(spark, words))


@query(
    "shadow_words",
    f"WITH {WORDS}, {DICT} SELECT DISTINCT r.word FROM (SELECT word FROM dict WHERE level >= 55 AND length(word) >= 4) r, (SELECT word AS w FROM dict WHERE level <= 35) c WHERE abs(length(r.word) - length(w)) <= 1 AND damerau_levenshtein(r.word, w) = 1 AND regexp_matches(r.word || w, '^[a-z]*$')",
)
def shadow_words(spark, sf_dir):
    plain = vocabulary.levelled(vocabulary_of(spark, sf_dir)).where(F.col("word").rlike("^[a-z]*$"))
    return known.shadows(plain.where("level >= 55").select("word"), plain)


_STATIC = f"fixed AS (SELECT * FROM (VALUES {dims.sql_values(dims.CONTRACTIONS)}) v(word, fixed))"


@query("contractions_static", f"WITH {WORDS}, {_STATIC} SELECT w.word, fixed, count(*) AS n FROM words w JOIN fixed ON w.word = fixed.word GROUP BY w.word, fixed")
def contractions_static(spark, sf_dir):
    return words_of(spark, sf_dir).join(F.broadcast(dims.contractions(spark)), "word").groupBy("word", "fixed").agg(F.count(F.lit(1)).alias("n"))


# Contractions are made from the corpus: an apostrophe goes in after the third letter of every longer word.
_APOSTROPHES = "made AS MATERIALIZED (SELECT DISTINCT left(word, 3) || '''' || substr(word, 4) AS word FROM words WHERE length(word) >= 4)"


@query("contractions_derived", f"WITH {WORDS}, {DICT}, {_APOSTROPHES} SELECT bare AS word, min(word) AS fixed FROM (SELECT replace(word, '''', '') AS bare, word FROM made WHERE NOT word LIKE '%''s') WHERE length(bare) >= 3 AND bare NOT IN (SELECT word FROM dict) GROUP BY bare HAVING count(DISTINCT word) = 1")
def contractions_derived(spark, sf_dir):
    every = vocabulary_of(spark, sf_dir)
    words = every.where("length(word) >= 4").select(F.concat(F.substring("word", 1, 3), F.lit("'"), F.expr("substring(word, 4)")).alias("word"))
    return known.derived_contractions(known.tables(spark, dictionary=vocabulary.levelled(every), lexicon=words))


_RARE = "rare AS MATERIALIZED (SELECT DISTINCT word FROM words WHERE word NOT IN (SELECT word FROM dict))"


def rare_and_listed(spark, sf_dir):
    """The words that the dictionary lacks, and the dictionary."""
    words = vocabulary_of(spark, sf_dir)
    listed = vocabulary.levelled(words)
    return merged(words.select("word"), listed.select("word"), "word", "left_anti"), listed


_ONE_LESS = "unnest(list_distinct(list_concat([word], list_transform(range(1, length(word)::BIGINT + 1), lambda i: left(word, i - 1) || substr(word, i + 1)))))"


@query(
    "suggest_candidates_d1",
    f"""WITH {WORDS}, {DICT}, {_RARE}, a AS (SELECT word, {_ONE_LESS} AS k FROM rare), b AS (SELECT word AS other, {_ONE_LESS} AS k FROM dict), p AS (SELECT DISTINCT word, other FROM a JOIN b USING (k))
SELECT word, other, damerau_levenshtein(word, other)::INT AS distance FROM p WHERE damerau_levenshtein(word, other) <= 1""",
)
def suggest_candidates_d1(spark, sf_dir):
    return suggest.within(*rare_and_listed(spark, sf_dir), 1)


_SPLIT = """usable AS (SELECT word FROM dict WHERE level <= 35 AND length(word) > 1 UNION SELECT unnest(['a', 'i'])),
cuts AS (SELECT word, left(word, i) AS head, substr(word, i + 1) AS tail FROM (SELECT word, unnest(range(1, length(word)::BIGINT)) AS i FROM rare WHERE length(word) >= 3)),
splits AS (SELECT word, min(head || ' ' || tail) AS split FROM cuts WHERE head IN (SELECT word FROM usable) AND tail IN (SELECT word FROM usable) GROUP BY word HAVING count(*) = 1)"""
_TWO_LESS = f"unnest(list_distinct(flatten(list_transform({sql.one_less('word')}, lambda k: {sql.one_less('k').replace('lambda i', 'lambda j').replace('i - 1', 'j - 1').replace('i + 1', 'j + 1')}))))"
_OWN = f"""a AS (SELECT word, {_TWO_LESS} AS k FROM rare), b AS (SELECT word AS other, {_TWO_LESS} AS k FROM dict), pairs AS (SELECT DISTINCT word, other FROM a JOIN b USING (k)),
near2 AS MATERIALIZED (SELECT word, other, {sql.osa_upto_2('word', 'other')} AS distance FROM pairs WHERE damerau_levenshtein(word, other) <= 2),
placed AS (SELECT n.word, other, distance, (70 - level) // 10 AS standing, row_number() OVER (PARTITION BY n.word ORDER BY distance, (70 - level) // 10 DESC, {sql.common_prefix('n.word', 'other')} DESC, {sql.common_prefix('reverse(n.word)', 'reverse(other)')} DESC, other) AS place
 FROM near2 n JOIN dict d ON n.other = d.word WHERE distance <= {dims.MAX_EDIT_DISTANCE}),
weighed AS (SELECT *, (ln(standing + 1.0::DOUBLE) + 1.0::DOUBLE) * pow({dims.EDIT_PENALTY}::DOUBLE, distance) * CASE WHEN regexp_matches(other, array_to_string(string_split(word, ''), '.*')) THEN {dims.SUBSEQUENCE_BONUS}::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM placed WHERE place <= {dims.MAX_SUGGESTIONS}),
scored AS (SELECT word, other, weight / sum(weight) OVER (PARTITION BY word) AS part, row_number() OVER (PARTITION BY word ORDER BY distance, weight DESC, place) AS i FROM weighed),
own AS (SELECT word, list({{'w': other, 's': score}} ORDER BY i) AS own FROM (SELECT word, other, i, {sql.rounded('part', 3)} AS score FROM scored) WHERE i = 1 OR score >= {dims.MIN_SUGGESTION_SCORE} GROUP BY word),
headed AS (SELECT r.word, split, coalesce(own, []) AS own, greatest(1.0::DOUBLE - list_sum(list_concat([0.0::DOUBLE], list_transform(coalesce(own, [])[:{dims.MAX_SUGGESTIONS - 1}], lambda x: x.s))) * {dims.SPLIT_SHARE}::DOUBLE, {dims.SPLIT_SHARE}::DOUBLE) AS head
 FROM rare r LEFT JOIN own o ON r.word = o.word LEFT JOIN splits s ON r.word = s.word)"""
_SHARED = sql.rounded(f"(x.s * {dims.SPLIT_SHARE}::DOUBLE)", 3)
_BEST = f"""{_SPLIT}, {_OWN},
best_of AS (SELECT word, CASE WHEN split IS NULL THEN own ELSE list_concat([{{'w': split, 's': {sql.rounded('head', 3)}}}], list_transform(own[:{dims.MAX_SUGGESTIONS - 1}], lambda x: {{'w': x.w, 's': {_SHARED}}})) END AS best FROM headed)"""


@query("suggest_top3", f"WITH {WORDS}, {DICT}, {_RARE}, {_BEST} SELECT word, array_to_string(list_transform(best, lambda x: x.w || ':' || x.s), ' ') AS suggestions FROM best_of")
def suggest_top3(spark, sf_dir):
    words, listed = rare_and_listed(spark, sf_dir)
    out = suggest.suggestions(words.select("word", F.lit(False).alias("want_name")), known.tables(spark, dictionary=listed))
    return out.select("word", F.transform("suggestions", lambda s: F.concat_ws(":", s["word"], s["score"].cast("string"))).alias("suggestions")).select("word", F.array_join("suggestions", " ").alias("suggestions"))


@query("split_compounds", f"WITH {WORDS}, {DICT}, {_RARE}, {_SPLIT} SELECT word, split FROM splits")
def split_compounds(spark, sf_dir):
    return known.split_in_two(*rare_and_listed(spark, sf_dir))


def neighbours(lines):
    """Prose words with the words before and after them in their line."""
    rows = lines.select("doc_id", "line", "words", posexplode("words").alias("pos", "word")).where("word is not null")
    p = F.col("pos")
    return rows.select("doc_id", "line", "pos", "word", F.get("words", p - 1).alias("prev"), F.get("words", p + 1).alias("next"))


_NEAR = "near AS MATERIALIZED (SELECT doc_id, line, pos - 1 AS pos, ws[pos] AS word, CASE WHEN pos > 1 THEN ws[pos - 1] END AS prev, ws[pos + 1] AS next FROM (SELECT doc_id, line, ws, unnest(range(1, len(ws)::BIGINT + 1)) AS pos FROM line_words))"


@query(
    "join_compounds",
    f"""WITH {WORDS}, {DICT}, {_NEAR}, common AS (SELECT word FROM dict WHERE level <= 50) SELECT doc_id, line, pos, n.word, CASE WHEN l.word IS NOT NULL THEN l.word ELSE r.word END AS joined FROM near n
LEFT JOIN common l ON l.word = n.prev || n.word LEFT JOIN common r ON r.word = n.word || n.next WHERE (l.word IS NOT NULL OR r.word IS NOT NULL) AND n.word NOT IN (SELECT word FROM dict WHERE level <= 35)""",
)
def join_compounds(spark, sf_dir):
    lines = lined(spark, sf_dir)
    words = vocabulary.levelled(counted(tokens.words_of(lines)))
    strange = neighbours(lines).join(words.where("level <= 35").select("word"), "word", "left_anti")
    return known.joined(strange, words).where("joined is not null").select("doc_id", "line", "pos", "word", "joined")


_SETS = f"sets AS (SELECT * FROM (VALUES {dims.sql_values([(w, a, i) for s in dims.CONFUSION_SETS for w in s for i, a in enumerate(s) if a != w])}) v(word, alternative, place))"
_BI = f"bi AS MATERIALIZED (SELECT gram, count(*) AS c FROM ({sql.grams(2, '1')}) GROUP BY gram)"
# Confusable words barely occur in invented prose, so frequent words stand in for them.
_SWAPPED = "swapped AS MATERIALIZED (SELECT doc_id, line, pos, CASE word WHEN 'the' THEN 'then' WHEN 'of' THEN 'form' WHEN 'and' THEN 'though' ELSE word END AS word, CASE prev WHEN 'the' THEN 'then' WHEN 'of' THEN 'form' WHEN 'and' THEN 'though' ELSE prev END AS prev, CASE next WHEN 'the' THEN 'then' WHEN 'of' THEN 'form' WHEN 'and' THEN 'though' ELSE next END AS next FROM near)"
_COUNTED = """bigrams AS MATERIALIZED (SELECT gram, sum(n)::BIGINT AS c FROM (SELECT prev || ' ' || word AS gram, count(*) AS n FROM swapped WHERE prev IS NOT NULL GROUP BY 1 UNION ALL SELECT prev || ' ' || CASE word WHEN 'then' THEN 'than' WHEN 'form' THEN 'from' ELSE 'through' END, count(*) * 3 FROM swapped WHERE word IN ('then', 'form', 'though') AND prev IS NOT NULL GROUP BY 1) GROUP BY gram)"""
_SCORES = """opts AS (SELECT DISTINCT doc_id, line, pos, s.word, prev, next, unnest([-1, place]) AS place, unnest([s.word, alternative]) AS option FROM swapped s JOIN sets ON s.word = sets.word),
scores AS (SELECT doc_id, line, pos, o.word, place, option, (coalesce(a.c, 0) + coalesce(b.c, 0))::BIGINT AS score FROM opts o LEFT JOIN bigrams a ON a.gram = o.prev || ' ' || o.option LEFT JOIN bigrams b ON b.gram = o.option || ' ' || o.next),
evidence AS (SELECT doc_id, line, pos, word, arg_max(option, score * 10 + place) FILTER (place >= 0) AS suggestion, max(score) FILTER (place < 0) AS written_evidence, max(score) FILTER (place >= 0) AS suggested_evidence FROM scores GROUP BY 1, 2, 3, 4)"""
_EVIDENCE = f"{_COUNTED}, {_SCORES}"


def swapped(lines):
    def other(c):
        return F.when(F.col(c) == "the", "then").when(F.col(c) == "of", "form").when(F.col(c) == "and", "though").otherwise(F.col(c))

    return neighbours(lines).withColumns({c: other(c) for c in ("word", "prev", "next")})


def swapped_bigrams(rows):
    held = rows.where("prev is not null")
    own = held.groupBy(F.concat_ws(" ", "prev", "word").alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    right = F.when(F.col("word") == "then", "than").when(F.col("word") == "form", "from").otherwise("through")
    more = held.where("word in ('then', 'form', 'though')").groupBy(F.concat_ws(" ", F.col("prev"), right).alias("gram")).agg((F.count(F.lit(1)) * 3).alias("n"))
    return own.unionByName(more).groupBy("gram").agg(F.sum("n").alias("count"))


@query("realword_evidence", f"WITH {WORDS}, {_NEAR}, {_SETS}, {_SWAPPED}, {_EVIDENCE} SELECT doc_id, line, pos, word, suggestion, written_evidence, suggested_evidence FROM evidence")
def realword_evidence(spark, sf_dir):
    rows = swapped(lined(spark, sf_dir))
    return realword.evidence(rows, swapped_bigrams(rows), ["doc_id", "line", "pos"])


_RATIO = "(suggested_evidence / (written_evidence + 1.0::DOUBLE))"


@query(
    "realword_findings",
    f"WITH {WORDS}, {_NEAR}, {_SETS}, {_SWAPPED}, {_EVIDENCE} SELECT doc_id, line, pos, word, suggestion, written_evidence, suggested_evidence, {sql.rounded(f'least(0.35::DOUBLE + {_RATIO} / ({_RATIO} + 8.0::DOUBLE), 0.85::DOUBLE)', 2)} AS confidence FROM evidence WHERE suggested_evidence >= 3 AND suggested_evidence >= 4 * (written_evidence + 1)",
)
def realword_findings(spark, sf_dir):
    rows = swapped(lined(spark, sf_dir))
    return realword.findings(rows, swapped_bigrams(rows), ["doc_id", "line", "pos"])


_CUE_BI = "bigrams AS MATERIALIZED (SELECT prev || ' ' || word AS gram, count(*) AS c FROM swapped WHERE prev IS NOT NULL GROUP BY 1)"
_MEMBERS = f"members AS (SELECT * FROM (VALUES {dims.sql_values([(w, i) for i, s in enumerate(dims.CONFUSION_SETS) for w in s])}) v(word, s))"


_CUE_TABLES = f"""{WORDS}, {_NEAR}, {_SWAPPED}, {_CUE_BI}, {DICT}, {_MEMBERS}, p AS (SELECT split_part(gram, ' ', 1) AS a, split_part(gram, ' ', 2) AS b, c FROM bigrams),
ctx AS (SELECT 'before' AS position, a AS cue, b AS word, c FROM p UNION ALL SELECT 'after', b, a, c FROM p),
r AS (SELECT position, cue, m.word, c, coalesce(lead(c) OVER w, 0) AS runner, row_number() OVER w AS i FROM ctx JOIN members m ON ctx.word = m.word WHERE cue IN (SELECT word FROM dict) WINDOW w AS (PARTITION BY position, cue, s ORDER BY c DESC, m.word DESC)),
g AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY c DESC, position, cue) AS k FROM r WHERE i = 1 AND c >= 3 AND c / (runner + 1.0::DOUBLE) >= 2)"""
_CUES = "SELECT position, cue, word, c AS count, least(round(c / (runner + 1.0::DOUBLE)), 99999.0::DOUBLE) AS margin FROM g WHERE k <= 24"


@query("derive_cues", f"WITH {_CUE_TABLES} {_CUES}")
def derive_cues(spark, sf_dir, lines=None):
    lines = lines or lined(spark, sf_dir)
    rows = swapped(lines).where("prev is not null")
    bigrams = rows.groupBy(F.concat_ws(" ", "prev", "word").alias("gram")).agg(F.count(F.lit(1)).alias("count"))
    return realword.derive_cues(bigrams, vocabulary.levelled(counted(tokens.words_of(lines))), min_count=3, ratio=2.0)


_FLIPPED = "CASE word WHEN 'then' THEN 'than' WHEN 'form' THEN 'from' ELSE 'through' END"
_SCALE = "least(greatest(log10(greatest(margin, 150.0::DOUBLE) / 150.0::DOUBLE) / log10(100000.0::DOUBLE / 150.0::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE)"


@query(
    "cue_findings",
    f"""WITH {_CUE_TABLES}, {_SETS}, cues AS ({_CUES}),
flip AS (SELECT position, cue, {_FLIPPED} AS picked, margin * 100 AS margin FROM cues),
sides AS (SELECT doc_id, line, pos, word, 0 AS side, 'before' AS position, prev AS cue FROM swapped WHERE prev IS NOT NULL UNION ALL SELECT doc_id, line, pos, word, 1, 'after', next FROM swapped WHERE next IS NOT NULL),
met AS (SELECT d.doc_id, d.line, d.pos, d.word, d.side, bool_or(f.picked = d.word) AS stop, bool_or(s.word IS NOT NULL) AS able, arg_max(f.picked, f.margin) FILTER (s.word IS NOT NULL) AS suggestion, max(f.margin) FILTER (s.word IS NOT NULL) AS margin
 FROM (SELECT * FROM sides WHERE word IN (SELECT word FROM sets)) d JOIN flip f USING (position, cue) LEFT JOIN sets s ON s.word = d.word AND s.alternative = f.picked GROUP BY 1, 2, 3, 4, 5),
turns AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line, pos ORDER BY side) AS turn FROM met WHERE stop OR able)
SELECT doc_id, line, pos, word, suggestion, {sql.rounded(f"(0.50::DOUBLE + 0.30::DOUBLE * {_SCALE})", 2)} AS confidence FROM turns WHERE turn = 1 AND NOT stop""",
)
def cue_findings(spark, sf_dir):
    lines = lined(spark, sf_dir)
    rows = swapped(lines)
    none = spark.createDataFrame([], "gram string, count long")
    flipped = derive_cues(spark, sf_dir, lines).select("position", "cue", F.when(F.col("word") == "then", "than").when(F.col("word") == "form", "from").otherwise("through").alias("word"), (F.col("margin") * 100).alias("margin"))
    return realword.cue_findings(rows, flipped, none, ["doc_id", "line", "pos"])


@query("export_words", f"WITH {_ENTRIES} SELECT word, provenance, sources FROM entries WHERE (provenance <> 'observed' OR sources >= 2) AND word NOT IN (SELECT word FROM dict)")
def export_words(spark, sf_dir):
    words = vocabulary_of(spark, sf_dir)
    return maintain.exportable(entries(spark, sf_dir, words), vocabulary.levelled(words)).select("word", "provenance", "sources")


@query("export_strongest", f"WITH {_ENTRIES} SELECT word, validity, sources FROM entries WHERE (provenance <> 'observed' OR sources >= 2) AND word NOT IN (SELECT word FROM dict) ORDER BY validity DESC, sources DESC, word LIMIT 1000")
def export_strongest(spark, sf_dir):
    words = vocabulary_of(spark, sf_dir)
    return maintain.strongest(entries(spark, sf_dir, words), vocabulary.levelled(words)).select("word", "validity", "sources")


@query("prune_grams", f"WITH {RUNS}, {_BI}, {DICT} SELECT gram FROM (SELECT gram, unnest(string_split(gram, ' ')) AS w FROM bi) GROUP BY gram HAVING bool_or(w NOT IN (SELECT word FROM dict))")
def prune_grams(spark, sf_dir):
    lines = lined(spark, sf_dir)
    return maintain.doomed_grams(phrases.run_bigrams(tokens.runs_of(lines)), vocabulary.levelled(counted(tokens.words_of(lines))))


@query(
    "status_maps",
    f"""WITH {RUNS}, {_BI}, {_EXPANDED}, {_SEEDED}, {_OBSERVED}, lexicon AS (SELECT coalesce(s.word, o.word) AS word, coalesce(s.r, 0) AS r FROM seeded s FULL JOIN observed o USING (word))
SELECT 'total' AS section, 'words' AS name, count(*) AS value FROM lexicon UNION ALL SELECT 'total', 'ngrams', count(*) FROM bi UNION ALL SELECT 'by_provenance', {_NAMES}[r + 1], count(*) FROM lexicon GROUP BY r
UNION ALL SELECT 'by_register', source, count(DISTINCT word) FROM words GROUP BY source UNION ALL SELECT 'documents', source, count(*) FROM documents GROUP BY source
UNION ALL SELECT 'messages', CASE WHEN conv_id % 3 = 0 THEN 'slack' WHEN conv_id % 3 = 1 THEN 'github' ELSE 'other' END, count(*) FROM conversations GROUP BY 2""",
)
def status_maps(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumnRenamed("source", "register")
    lines = lined(spark, sf_dir)
    words = tokens.words_of(lines)
    registers = vocabulary.by_register(words.withColumnRenamed("source", "register"))
    prose = docs.groupBy("register").agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("documents"))
    prefix = F.when(F.col("conv_id") % 3 == 0, "slack:").when(F.col("conv_id") % 3 == 1, "gh:").otherwise("http:")
    captured = read(spark, sf_dir, "conversations").select(F.concat(prefix, F.col("conv_id").cast("string")).alias("source_key"))
    return maintain.status(lexicon(spark, sf_dir, counted(words)), phrases.run_bigrams(tokens.runs_of(lines)), registers, prose, captured)


def checker_tables(spark, sf_dir):
    lines = lined(spark, sf_dir)
    listed = vocabulary.levelled(counted(tokens.words_of(lines)))
    return known.tables(spark, dictionary=listed, bigrams=phrases.run_bigrams(tokens.runs_of(lines)), people=people(spark, sf_dir))


def people(spark, sf_dir):
    """Customers and suppliers are the people; their numbers stand for the days they were seen on."""
    parties = read(spark, sf_dir, "customer").selectExpr("c_name AS n", "c_custkey AS k").unionByName(read(spark, sf_dir, "supplier").selectExpr("s_name AS n", "s_suppkey AS k"))
    return parties.groupBy(F.lower("n").alias("name")).agg((F.max("k") % 9).cast("long").alias("days"), F.min("n").alias("display"))


def _flat(rows):
    return rows.withColumn("suggestions", F.array_join(F.transform("suggestions", lambda s: F.concat_ws(":", s["word"], s["score"].cast("string"))), " "))


def _checked(source: str, key: str, text: str) -> str:
    return f"{RUNS}, {DICT}, {_BI}, {_SETS}, {checker_sql.findings(source, key, text, _BEST, _SCORES)}"


@query("findings_documents", f"WITH {_checked('documents', 'doc_id', 'text')} {checker_sql.flat('doc_id')}")
def findings_documents(spark, sf_dir):
    return _flat(findings.findings(documents(spark, sf_dir), checker_tables(spark, sf_dir)))


@query("findings_pages", f"WITH {_checked('pages', 'page_id', 'html')} {checker_sql.flat('page_id')}")
def findings_pages(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    return _flat(findings.findings(pages, checker_tables(spark, sf_dir), key="page_id"))


def _draw(use, n):
    return f"(('0x' || substr(md5(concat_ws('|', '1', item_id::VARCHAR, line::VARCHAR, '{use}')), 1, 8))::BIGINT % greatest({n}, 1))"


_LETTERS_OF = "regexp_replace(t, '[^A-Za-z]', '', 'g')"
_CHECKABLE = f"length(t) >= 3 AND regexp_matches(t, '^[A-Za-z''-]+$') AND regexp_matches({_LETTERS_OF}, '[a-z]') AND NOT regexp_matches({_LETTERS_OF}, '^[A-Z]{{2,}}s$') AND NOT regexp_matches({_LETTERS_OF}, '[a-z][A-Z]')"
_OPTIONS = "MAP {" + ", ".join(f"'{w}': {v}" for w, v in evaluate.OPTIONS.items()) + "}"
_NEAR_KEYS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in dims.NEIGHBOURS.items()) + "}"
_INJECTED = f"""{sql.lines("benchmark", "item_id")},
drawn AS (SELECT item_id, line, raw, list_filter({sql.tokens("raw")}, lambda t: {_CHECKABLE}) AS ts FROM lines WHERE {sql.prose("raw")}),
picked AS (SELECT item_id, line, raw, ts[{_draw("word", "len(ts)")} + 1] AS original FROM drawn WHERE len(ts) > 0),
planned AS (SELECT *, lower(original) AS w, {_OPTIONS}[lower(original)] AS others, {list(evaluate.SLIPS)}[{_draw("kind", 4)} + 1] AS slip, strpos(raw, original) AS place FROM picked),
placed AS (SELECT *, others IS NOT NULL AND {_draw("real", 2)} = 0 AS swap, {_draw("at", "CASE WHEN slip = 'transposition' THEN length(w) - 1 ELSE length(w) END")} AS i FROM planned),
keyed AS (SELECT *, {_NEAR_KEYS}[substr(w, i + 1, 1)] AS keys FROM placed),
made AS (SELECT *, CASE WHEN swap THEN others[{_draw("option", "len(others)")} + 1] WHEN length(w) < 4 THEN NULL WHEN slip = 'transposition' THEN left(w, i) || substr(w, i + 2, 1) || substr(w, i + 1, 1) || substr(w, i + 3) WHEN slip = 'deletion' THEN left(w, i) || substr(w, i + 2)
 WHEN slip = 'insertion' THEN left(w, i) || substr(w, i + 1, 1) || substr(w, i + 1) ELSE left(w, i) || substr(keys, {_draw("near", "length(keys)")} + 1, 1) || substr(w, i + 2) END AS mutated FROM keyed),
injected AS (SELECT item_id, line, original, mutated, CASE WHEN swap THEN 'real-word' ELSE slip END AS kind FROM made WHERE mutated IS NOT NULL AND mutated <> w AND NOT regexp_matches(CASE WHEN place > 1 THEN substr(raw, place - 1, 1) ELSE '' END || substr(raw, place + length(original), 1), '[\\p{{L}}\\p{{N}}]'))"""


@query("eval_injections", f"WITH {_INJECTED} SELECT item_id, line::INT AS line, original, mutated, kind FROM injected")
def eval_injections(spark, sf_dir):
    rows = evaluate.injected(read(spark, sf_dir, "benchmark"), key="item_id", rate=1)
    return rows.select("item_id", F.explode("injections").alias("x")).select("item_id", "x.*")


def evaluated(spark, sf_dir):
    docs = evaluate.injected(read(spark, sf_dir, "benchmark"), key="item_id", rate=1)
    made = docs.select("item_id", F.explode("injections").alias("x")).select("item_id", "x.*")
    return findings.findings(docs.select("item_id", "text"), checker_tables(spark, sf_dir), key="item_id"), made


_EVALUATED = f"""made_errors AS MATERIALIZED (WITH {_INJECTED} SELECT item_id, line, original, mutated, kind FROM injected),
damaged AS MATERIALIZED (WITH {sql.lines("benchmark", "item_id")} SELECT item_id, string_agg(CASE WHEN original IS NULL THEN raw ELSE left(raw, strpos(raw, original) - 1) || mutated || substr(raw, strpos(raw, original) + length(original)) END, chr(10) ORDER BY line) AS text
 FROM lines LEFT JOIN made_errors USING (item_id, line) GROUP BY item_id),
{_checked('damaged', 'item_id', 'text')},
first_found AS (SELECT doc_id, line, lower(word) AS w, min(col) AS hit, arg_min(list_transform(suggestions, lambda x: lower(x.w)), col) AS fixes FROM found GROUP BY 1, 2, 3),
matched AS (SELECT item_id, e.line, kind, mutated, hit, coalesce(list_contains(f.fixes, lower(original)), false) AS corrected FROM made_errors e LEFT JOIN first_found f ON f.doc_id = item_id AND f.line = e.line AND f.w = lower(mutated)),
hits AS (SELECT count(mutated) AS injected, (SELECT count(*) FROM found) AS findings, count(hit) AS caught, count_if(corrected)::BIGINT AS corrected, (SELECT count(*) FROM found) - (SELECT count(*) FROM (SELECT DISTINCT item_id, line, hit FROM matched WHERE hit IS NOT NULL)) AS false_positives,
 (WITH {sql.prose_words("benchmark", "item_id")} SELECT count(*) FROM words)::DOUBLE AS words FROM matched)"""


def _share(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE {a} / {b}::DOUBLE END"


@query(
    "eval_score",
    f"""WITH {_EVALUATED} SELECT injected, findings, caught, corrected, false_positives, words, {_share('(false_positives * 1000.0::DOUBLE)', 'words')} AS false_positive_rate, {_share('caught', 'injected')} AS recall,
{_share('caught', 'findings')} AS precision, {_share('corrected', 'caught')} AS correction_rate FROM hits""",
)
def eval_score(spark, sf_dir):
    found, made = evaluated(spark, sf_dir)
    words = tokens.words(read(spark, sf_dir, "benchmark")).count()
    return evaluate.score(found, made, words, key="item_id")


@query("eval_by_kind", f"WITH {_EVALUATED} SELECT kind, count(*) AS injected, count(hit) AS caught, {_share('count(hit)', 'count(*)')} AS recall FROM matched GROUP BY kind")
def eval_by_kind(spark, sf_dir):
    return evaluate.score_by_kind(*evaluated(spark, sf_dir), key="item_id")


_SPEAKERS = "upper(left(role, 1)) || substr(role, 2) || ' ' || (conv_id % 7)"


@query("people_table", f"SELECT lower({_SPEAKERS}) AS name, min({_SPEAKERS}) AS display, count(*) AS count, count(DISTINCT turn % 5) AS days FROM conversations GROUP BY 1")
def people_table(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select(
        F.concat_ws(" ", F.initcap("role"), (F.col("conv_id") % 7).cast("string")).alias("display"), F.concat_ws("#", "conv_id", "turn").alias("source_key"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("turn") % 5).cast("int")).alias("day")
    )
    return hooks.people(rows, F.col("day").cast("timestamp"))


@query("ingest_records", "SELECT CASE WHEN role = 'assistant' THEN 'other' ELSE 'user' END AS authored_by, register, count(*) AS n, sum(length(body))::BIGINT AS chars FROM (SELECT role, text AS body, CASE WHEN conv_id % 2 = 0 THEN 'email' ELSE 'note' END AS register FROM conversations WHERE trim(text) <> '') GROUP BY 1, 2")
def ingest_records(spark, sf_dir):
    """Conversations as JSON: an array for each even conversation, lines of objects for each odd one."""
    register = F.when(F.col("conv_id") % 2 == 0, "email").otherwise("unheard-of")
    record = F.to_json(F.struct(F.col("text").alias("body"), F.col("role").alias("author"), register.alias("register")))
    texts = read(spark, sf_dir, "conversations").select("conv_id", record.alias("r")).groupBy("conv_id").agg(F.collect_list("r").alias("rs"))
    values = texts.select(F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("["), F.array_join("rs", ","), F.lit("]"))).otherwise(F.array_join("rs", "\n")).alias("value"))
    rows = ingest.attributed(ingest.records(values), ["user", "system"], register="note")
    return rows.groupBy("authored_by", "register").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("body")).alias("chars"))


_PARTIES = "p AS MATERIALIZED (SELECT DISTINCT lower(c_name) AS name FROM customer UNION SELECT DISTINCT lower(s_name) FROM supplier)"
_ONE_LESS_OF = "unnest(list_distinct(list_concat([{0}], list_transform(range(1, length({0})::BIGINT + 1), lambda i: left({0}, i - 1) || substr({0}, i + 1)))))"


@query(
    "name_matches",
    f"""WITH {_PARTIES}, c AS MATERIALIZED (SELECT DISTINCT left(name, length(name) - 1) AS candidate FROM p UNION SELECT DISTINCT substr(name, 2) FROM p), a AS (SELECT candidate, {_ONE_LESS_OF.format('candidate')} AS k FROM c), b AS (SELECT name, {_ONE_LESS_OF.format('name')} AS k FROM p),
m AS (SELECT DISTINCT candidate, name FROM a JOIN b USING (k))
SELECT candidate, min(name) AS name, count(*) AS matches FROM m WHERE damerau_levenshtein(candidate, name) <= 1 AND length(candidate) >= 4 AND candidate NOT IN (SELECT name FROM p) GROUP BY candidate HAVING count(*) = 1""",
)
def name_matches(spark, sf_dir):
    """Names of customers and suppliers with a letter lost at either end, and the only person each can be."""
    names = people(spark, sf_dir).select(F.col("name").alias("word"))
    short = names.select(F.expr("left(word, length(word) - 1)").alias("word")).union(names.select(F.expr("substring(word, 2)")))
    asked = short.where(F.length("word") >= dims.MIN_NAME_LENGTH).distinct().join(names, "word", "left_anti")
    near = suggest.within(asked, names, 1).groupBy("word").agg(F.min("other").alias("name"), F.count(F.lit(1)).alias("matches"))
    return near.where("matches = 1").select(F.col("word").alias("candidate"), "name", "matches")
