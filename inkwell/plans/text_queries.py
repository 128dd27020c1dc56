"""Queries over texts: tokens, predicates, phrases, sentences, complexity, authorship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import authorship
from inkwell.functions import text as tx
from inkwell.functions.dims import ENVELOPES, MARKERS
from inkwell.functions.lets import round_half_away
from inkwell.functions.mask import mask
from inkwell.operators import complexity, ingest, learn, phrases, tokens, vocabulary
from inkwell.plans import sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. One that comes in fewer parts than there are cores (a single row group) is dealt out first; larger ones stay as they are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")


WORDS = sql.prose_words()


@query("token_counts", f"WITH {WORDS} SELECT lang, count(*) AS tokens, count(DISTINCT word) AS types, sum(length(word))::BIGINT AS chars FROM words GROUP BY lang")
def token_counts(spark, sf_dir):
    counts = tokens.words(documents(spark, sf_dir)).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("lang").agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("types"), F.sum(F.length("word") * F.col("c")).alias("chars"))


@query("vocab_by_register", f"WITH {WORDS} SELECT word, source AS register, count(*) AS count FROM words GROUP BY word, source")
def vocab_by_register(spark, sf_dir):
    return vocabulary.by_register(tokens.words(documents(spark, sf_dir)).withColumnRenamed("source", "register"))


@query("typography_fold", f"SELECT doc_id, md5({sql.fold('text')}) AS folded_md5, length({sql.fold('text')}) AS chars FROM documents")
def typography_fold(spark, sf_dir):
    folded = tx.fold_typography(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.md5(folded).alias("folded_md5"), F.length(folded).alias("chars"))


_TOKENS = sql.tokens("text")


@query("normalize_words", f"SELECT token, {sql.normalise('token')} AS word, {sql.lexical(sql.normalise('token'))} AS lexical, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM documents) GROUP BY token")
def normalize_words(spark, sf_dir):
    rows = documents(spark, sf_dir).select(F.explode(tx.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    word = tx.normalise(F.col("token"))
    return rows.select("token", word.alias("word"), tx.is_lexical(word).alias("lexical"), "n")


_ALPHA = "regexp_replace(token, '[^A-Za-z]', '', 'g')"


@query(
    "checkable_tokens",
    f"SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM documents) WHERE length(token) >= 3 AND regexp_matches(token, '^[A-Za-z''-]+$') AND regexp_matches({_ALPHA}, '[a-z]') "
    f"AND NOT regexp_matches({_ALPHA}, '^[A-Z]{{2,}}s$') AND NOT regexp_matches({_ALPHA}, '[a-z][A-Z]') GROUP BY token",
)
def checkable_tokens(spark, sf_dir):
    rows = documents(spark, sf_dir).select(F.explode(tx.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return rows.where(tx.is_checkable(F.col("token")))


@query(
    "prose_lines",
    f"WITH {sql.lines()}, {sql.lines('pages', 'page_id', 'html').replace('lines AS', 'page_lines AS', 1)} SELECT kind, prose, count(*) AS n FROM (SELECT 'document' AS kind, {sql.prose('raw')} AS prose FROM lines "
    f"UNION ALL SELECT 'page', {sql.prose('raw')} FROM page_lines) GROUP BY kind, prose",
)
def prose_lines(spark, sf_dir):
    # a last line that is empty is no line; the SQL counts it, so it is put back
    both = documents(spark, sf_dir).select(F.lit("document").alias("kind"), "text").unionByName(read(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("html").alias("text")))
    rows = both.select("kind", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("raw"))
    return rows.groupBy("kind", tx.is_prose(F.regexp_replace("raw", "\r$", "")).alias("prose")).agg(F.count(F.lit(1)).alias("n"))


_PARTS = "list_filter(list_transform(regexp_split_to_array(regexp_replace(name, '([A-Z])', ' \\1', 'g'), '[_\\-./ ]+'), lambda p: lower(p)), lambda p: regexp_matches(p, '^[a-z]{2,}$'))"


@query("split_identifier_parts", f"SELECT part, count(*) AS n FROM (SELECT unnest({_PARTS}) AS part FROM (SELECT url AS name FROM pages UNION ALL SELECT p_name FROM part UNION ALL SELECT c_name FROM customer)) GROUP BY part")
def split_identifier_parts(spark, sf_dir):
    names = read(spark, sf_dir, "pages").select(F.col("url").alias("name")).unionByName(read(spark, sf_dir, "part").select(F.col("p_name").alias("name"))).unionByName(read(spark, sf_dir, "customer").select(F.col("c_name").alias("name")))
    return names.select(F.explode(tx.split_identifier(F.col("name"))).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "mask_regions",
    f"""WITH {sql.lines("pages", "page_id", "html")}, folded AS (SELECT page_id, line, raw, {sql.fold("raw")} AS x FROM lines), regions AS (SELECT page_id, line, raw, x, {sql.mask_in_place("x")} AS vs FROM folded),
masked AS (SELECT page_id, line, raw, {sql.union_of_spaces("x", "vs")} AS m FROM regions) SELECT page_id, line::INT AS line, length(raw)::INT AS chars, length(m)::INT AS masked_chars, md5(m) AS masked_md5 FROM masked""",
)
def mask_regions(spark, sf_dir):
    pages = tokens.lines(read(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")))
    masked = mask(tx.fold_typography(F.col("raw")))
    return pages.select("page_id", "line", F.length("raw").alias("chars"), F.length(masked).alias("masked_chars"), F.md5(masked).alias("masked_md5"))


RUNS = f"{WORDS}, {sql.runs()}"
_BIGRAMS = f"bigrams AS MATERIALIZED (SELECT gram, source, count(*)::DOUBLE AS k FROM ({sql.grams(2, 'source')}) GROUP BY gram, source)"


@query("bigram_counts", f"WITH {RUNS}, {_BIGRAMS} SELECT gram, sum(k)::BIGINT AS count FROM bigrams GROUP BY gram")
def bigram_counts(spark, sf_dir):
    return phrases.bigram_counts(documents(spark, sf_dir))


def _g2(by: str, tail: str) -> str:
    return f"""WITH {RUNS}, {_BIGRAMS}, c AS MATERIALIZED (SELECT {by} AS by_, gram, sum(k) AS k, regexp_extract(gram, '^(.*) [^ ]+$', 1) AS head, regexp_extract(gram, '([^ ]+)$', 1) AS tail FROM bigrams GROUP BY 1, 2),
w AS MATERIALIZED (SELECT by_, gram, k, sum(k) OVER (PARTITION BY by_, head) AS h, sum(k) OVER (PARTITION BY by_, tail) AS t, sum(k) OVER (PARTITION BY by_) AS n FROM c),
s AS MATERIALIZED (SELECT by_, gram, k, h - k AS k12, t - k AS k21, greatest(n - h - t + k, 0.0) AS k22 FROM w WHERE k >= 2),
g AS (SELECT by_, gram, k::BIGINT AS count, {sql.rounded("x", 2)} AS log_likelihood FROM (SELECT *, {sql.log_likelihood("k", "k12", "k21", "k22")} AS x FROM s)) {tail}"""


@query("phrases_g2", _g2("''", "SELECT gram, count, log_likelihood FROM g ORDER BY log_likelihood DESC, count DESC, gram LIMIT 25"))
def phrases_g2(spark, sf_dir):
    return phrases.collocations(phrases.bigram_counts(documents(spark, sf_dir)))


@query("phrases_g2_by_register", _g2("source", "SELECT by_ AS register, gram, count, log_likelihood FROM g"))
def phrases_g2_by_register(spark, sf_dir):
    counts = phrases.bigram_counts(documents(spark, sf_dir).withColumnRenamed("source", "register"), "register")
    return phrases.collocations(counts, limit=None, within=["register"])


def _gate() -> str:
    ctes = [f"g2 AS (SELECT gram, source, (doc_id, line, run) AS place, count(*) AS c FROM ({sql.grams(2, 'doc_id, line, run, source')}) GROUP BY 1, 2, 3)"]
    for n in (3, 4, 5):
        ctes.append(f"m{n} AS (SELECT gram, place, sum(sum(c)) OVER (PARTITION BY gram ORDER BY place ROWS UNBOUNDED PRECEDING) AS total FROM g{n - 1} GROUP BY gram, place)")
        ctes.append(f"r{n} AS (SELECT gram, regexp_replace(gram, ' [^ ]+$', '') AS prefix, source, (doc_id, line, run) AS place, count(*) AS c FROM ({sql.grams(n, 'doc_id, line, run, source')}) GROUP BY 1, 2, 3, 4)")
        ctes.append(f"g{n} AS (SELECT r.gram, r.source, r.place, r.c FROM r{n} r JOIN m{n} m ON r.prefix = m.gram AND r.place = m.place WHERE m.total >= 2)")
    parts = " UNION ALL ".join(f"SELECT gram, {n} AS n, source AS register, sum(c)::BIGINT AS count FROM g{n} GROUP BY gram, source" for n in (2, 3, 4, 5))
    return f"WITH {RUNS}, {', '.join(ctes)} {parts}"


@query("phrase_gate", _gate())
def phrase_gate(spark, sf_dir):
    runs = tokens.runs(documents(spark, sf_dir)).withColumnRenamed("source", "register")
    return phrases.gated_counts(runs, ["doc_id", "line", "run"], "register").select("gram", "n", "register", "count")


_SHAPES = f"""shapes AS MATERIALIZED (SELECT doc_id, source, len(w) AS length, list_sum(list_transform(w, lambda x: {sql.syllables("x")}))::BIGINT AS syl FROM
 (SELECT doc_id, source, list_filter(list_transform({sql.tokens(sql.mask("s"))}, lambda x: {sql.normalise("x")}), lambda x: regexp_matches(x, '\\p{{L}}')) AS w FROM
 (SELECT doc_id, source, {sql.fold("s")} AS s FROM (SELECT doc_id, source, unnest({sql.sentences("coalesce(text, '')")}) AS s FROM documents))) WHERE len(w) > 0)"""


@query("sentence_lengths", f"WITH {_SHAPES} SELECT source AS register, least(length, 60) AS length, count(*) AS count FROM shapes GROUP BY 1, 2")
def sentence_lengths(spark, sf_dir):
    return complexity.sentence_histogram(documents(spark, sf_dir).withColumnRenamed("source", "register"), "register")


@query(
    "prose_stats",
    f"""WITH {_SHAPES}, wide AS (SELECT source, count(*) AS sentences, sum(length)::BIGINT AS words, sum(syl)::BIGINT AS syllables FROM shapes GROUP BY source)
SELECT register, metric, value FROM (SELECT source AS register, 'documents' AS metric, count(*) AS value FROM documents GROUP BY source UNION ALL SELECT source, 'sentences', sentences FROM wide
UNION ALL SELECT source, 'words', words FROM wide UNION ALL SELECT source, 'syllables', syllables FROM wide) WHERE value > 0""",
)
def prose_stats(spark, sf_dir):
    return complexity.prose_stats(documents(spark, sf_dir).withColumnRenamed("source", "register"), "register")


_VOCABULARY = """count(*) AS types, sum(c)::BIGINT AS tokens, count(*)::DOUBLE / sum(c) AS type_token_ratio, count(*) / sqrt(sum(c)::DOUBLE) AS guiraud_r, (count(*) FILTER (c = 1))::DOUBLE / count(*) AS hapax_ratio,
 sum(length(word) * c)::DOUBLE / sum(c) AS mean_word_length, coalesce(sum(c) FILTER (length(word) >= 7), 0)::DOUBLE / sum(c) AS long_word_ratio"""
_MEASURES = ("type_token_ratio", "guiraud_r", "hapax_ratio", "mean_word_length", "long_word_ratio")


def _six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: round_half_away(F.col(n), 6) for n in names})


def _six_sql(*names: str) -> str:
    return ", ".join(f"{sql.rounded(n, 6)} AS {n}" for n in names)


@query("complexity_corpus", f"WITH {WORDS}, v AS (SELECT {_VOCABULARY} FROM (SELECT word, count(*) AS c FROM words GROUP BY word)) SELECT tokens, types, {_six_sql(*_MEASURES)} FROM v")
def complexity_corpus(spark, sf_dir):
    counts = tokens.words(documents(spark, sf_dir)).groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    return _six(complexity.from_counts(counts), *_MEASURES)


_OPEN = f"""open_shapes AS (SELECT doc_id, count(*) AS sentences, stddev_pop(length) AS sd FROM (SELECT doc_id, len(list_filter({sql.tokens("s")}, lambda x: regexp_matches(x, '\\p{{L}}'))) AS length FROM
 (SELECT doc_id, {sql.fold("s")} AS s FROM (SELECT doc_id, unnest({sql.sentences("coalesce(text, '')")}) AS s FROM documents))) WHERE length > 0 GROUP BY doc_id)"""
_READ = ("mean_sentence_length", "sentence_length_stddev", "mean_syllables_per_word", "flesch_reading_ease")


@query(
    "complexity_by_doc",
    f"""WITH {WORDS}, {_OPEN}, c AS (SELECT doc_id, word, count(*) AS c FROM words GROUP BY doc_id, word), v AS (SELECT doc_id, {_VOCABULARY}, sum({sql.syllables("word")} * c)::DOUBLE AS syl FROM c GROUP BY doc_id),
w AS (SELECT v.*, coalesce(sentences, 0) AS sentences, CASE WHEN coalesce(sentences, 0) = 0 THEN 0.0 ELSE tokens::DOUBLE / sentences END AS mean_sentence_length, coalesce(sd, 0.0) AS sentence_length_stddev, syl / tokens AS mean_syllables_per_word FROM v LEFT JOIN open_shapes USING (doc_id)),
x AS (SELECT *, 206.835::DOUBLE - 1.015::DOUBLE * mean_sentence_length - 84.6::DOUBLE * mean_syllables_per_word AS flesch_reading_ease FROM w)
SELECT doc_id, tokens, types, {_six_sql(*_MEASURES)}, sentences, {_six_sql(*_READ)} FROM x""",
)
def complexity_by_doc(spark, sf_dir):
    return _six(complexity.by_text(documents(spark, sf_dir)), *_MEASURES, *_READ)


@query(
    "readability_corpus",
    f"""WITH {_SHAPES}, s AS (SELECT count(*) AS sentences, sum(length)::DOUBLE AS words, sum(syl)::DOUBLE AS syl FROM shapes), d AS (SELECT stddev_pop(least(length, 60)) AS sd FROM shapes),
x AS (SELECT sentences, words / sentences AS mean_sentence_length, sd AS sentence_length_stddev, syl / words AS mean_syllables_per_word, 206.835::DOUBLE - 1.015::DOUBLE * (words / sentences) - 84.6::DOUBLE * (syl / words) AS flesch_reading_ease FROM s, d)
SELECT sentences, {_six_sql(*_READ)} FROM x""",
)
def readability_corpus(spark, sf_dir):
    shapes = tokens.sentence_shapes(documents(spark, sf_dir).select("text"))
    n, w, y = F.count(F.lit(1)), F.sum("length"), F.sum("syllables")
    capped = F.least("length", F.lit(complexity.LONGEST_SENTENCE))
    rows = shapes.agg(n.alias("sentences"), complexity.ratio(w, n).alias("mean_sentence_length"), F.coalesce(F.stddev_pop(capped), F.lit(0.0)).alias("sentence_length_stddev"), complexity.ratio(y, w).alias("mean_syllables_per_word"), complexity.flesch(n, w, y).alias("flesch_reading_ease"))
    return _six(rows, *_READ)


@query("syllables", f"WITH {WORDS} SELECT word, {sql.syllables('word')} AS syllables FROM (SELECT DISTINCT word FROM words)")
def syllables(spark, sf_dir):
    return tokens.words(documents(spark, sf_dir)).select("word").distinct().select("word", tx.syllables(F.col("word")).alias("syllables"))


@query(
    "exemplars_top25",
    f"WITH {WORDS}, e AS (SELECT source AS register, doc_id, line, len(ws) AS score, trim({sql.fold('raw')}) AS text FROM line_words WHERE len(ws) >= 6) "
    "SELECT register, doc_id, line, score, text FROM (SELECT *, row_number() OVER (PARTITION BY register ORDER BY score DESC, doc_id DESC, line DESC) AS i FROM e) WHERE i <= 25",
)
def exemplars_top25(spark, sf_dir):
    return learn.exemplars(documents(spark, sf_dir).withColumnRenamed("source", "register"), "register", ["doc_id", "line"])


_BARE = "lower(trim(regexp_replace(regexp_replace(regexp_replace(x, '^[^\\p{L}\\p{N}]+', ''), '\\([^)]*(\\)|$)', '', 'g'), '[\\[\\]*_`]', '', 'g')))"
_MARKED = f"list_transform(string_split(text, chr(10)), lambda x: regexp_matches({_BARE}, '^({'|'.join(MARKERS)})'))"


@query("authored_split", f"SELECT role, who, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT role, text, CASE WHEN list_contains({_MARKED}, true) OR role = 'assistant' THEN 'assistant' WHEN role = 'user' THEN 'user' ELSE 'other' END AS who FROM conversations WHERE trim(text) <> '') GROUP BY role, who")
def authored_split(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("role", F.col("text").alias("body"), F.col("role").alias("author"))
    made = ingest.attributed(rows, selves=["user"]).withColumn("who", F.when((F.col("authored_by") == "assistant") | (F.col("role") == "assistant"), "assistant").when(F.col("authored_by") == "user", "user").otherwise("other"))
    return made.groupBy("role", "who").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("body")).alias("chars"))


_TURNS = sql.prose_words("conversations", "conv_id, turn, role")


@query("non_user_vocabulary", f"WITH {_TURNS} SELECT word, count(*) FILTER (role = 'user') AS count, count(DISTINCT (conv_id, turn)) AS sources FROM words GROUP BY word")
def non_user_vocabulary(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select(F.concat_ws("#", "conv_id", "turn").alias("doc"), F.lit("other").alias("register"), F.col("text").alias("body"), F.when(F.col("role") == "user", "user").otherwise("assistant").alias("authored_by"))
    words = learn.learned_words(rows)
    return words.select("word", "count", "sources")


@query("strip_trailer", f"SELECT conv_id, turn, CASE WHEN list_position(m, true) > 0 THEN regexp_replace(array_to_string(string_split(text, chr(10))[1:list_position(m, true) - 1], chr(10)), '\\s+$', '') ELSE text END AS body FROM (SELECT conv_id, turn, text, {_MARKED} AS m FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN text || chr(10) || chr(10) || '* [Generated with Claude](http://x) now' || chr(10) || 'tail' ELSE text END AS text FROM conversations))")
def strip_trailer(spark, sf_dir):
    trailer = "\n\n* [Generated with Claude](http://x) now\ntail"
    rows = read(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 3 == 1, F.concat("text", F.lit(trailer))).otherwise(F.col("text")))
    return rows.select("conv_id", "turn", authorship.strip_trailer(F.col("text")).alias("body"))


def _envelope_sql() -> str:
    x = "text"
    for t in ENVELOPES:
        x = f"regexp_replace({x}, '(?s)<{t}>.*?(</{t}>|$)', ' ', 'g')"
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


_WRAPPED = "CASE WHEN turn % 4 = 0 THEN '<system-reminder>be kind</system-reminder> ' || text WHEN turn % 4 = 2 THEN text || ' <command-args>x' ELSE text END"


@query("strip_envelopes", f"SELECT conv_id, turn, body FROM (SELECT conv_id, turn, {_envelope_sql()} AS body FROM (SELECT conv_id, turn, {_WRAPPED} AS text FROM conversations)) WHERE body <> '' AND NOT starts_with(body, '/')")
def strip_envelopes(spark, sf_dir):
    text = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("<system-reminder>be kind</system-reminder> "), "text")).when(F.col("turn") % 4 == 2, F.concat("text", F.lit(" <command-args>x"))).otherwise(F.col("text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", authorship.typed_prompt(text).alias("body")).where("body is not null")


@query("claim_dedup", "SELECT 'conv:' || conv_id AS source_key, min(turn) AS turn, arg_min(text, turn) AS body FROM conversations GROUP BY conv_id")
def claim_dedup(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select(F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("source_key"), "turn", F.col("text").alias("body"))
    return ingest.claimed(rows, order="turn").select("source_key", "turn", "body")
