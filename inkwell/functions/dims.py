"""Small fixed tables of the checker. Anything larger (dictionary, cues, core words) is a parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Sets of real words that are typed for one another.
CONFUSION_SETS = (
    ("form", "from"), ("casual", "causal"), ("quiet", "quite"), ("trial", "trail"), ("manger", "manager"), ("defiantly", "definitely"),
    ("pubic", "public"), ("untied", "united"), ("filed", "field"), ("angel", "angle"), ("lose", "loose"), ("then", "than"), ("their", "there"),
    ("weather", "whether"), ("discrete", "discreet"), ("complement", "compliment"), ("principal", "principle"), ("affect", "effect"),
    ("sting", "string"), ("thorough", "through", "though"), ("county", "country"), ("unclear", "nuclear"), ("statistic", "statistics"),
)

# Contractions as typed without their apostrophe.
CONTRACTIONS = (
    ("dont", "don't"), ("didnt", "didn't"), ("doesnt", "doesn't"), ("isnt", "isn't"), ("arent", "aren't"), ("wasnt", "wasn't"), ("werent", "weren't"),
    ("wouldnt", "wouldn't"), ("couldnt", "couldn't"), ("shouldnt", "shouldn't"), ("havent", "haven't"), ("hasnt", "hasn't"), ("hadnt", "hadn't"),
    ("mustnt", "mustn't"), ("neednt", "needn't"), ("wouldve", "would've"), ("couldve", "could've"), ("shouldve", "should've"), ("youre", "you're"),
    ("theyre", "they're"), ("youve", "you've"), ("weve", "we've"), ("theyve", "they've"), ("youll", "you'll"), ("theyll", "they'll"), ("itll", "it'll"),
    ("youd", "you'd"), ("theyd", "they'd"), ("thats", "that's"), ("whats", "what's"), ("theres", "there's"), ("heres", "here's"), ("wheres", "where's"),
    ("whos", "who's"), ("oclock", "o'clock"),
)

# First words of lines that mark a text as an assistant's.
MARKERS = ("co-authored-by: claude", "co-authored-by: anthropic", "generated with claude", "generated by claude", "vibed with claude", "claudomatic:", "vibe-coded with claude")

# Tags whose content a tool put into a prompt, in the order of removal.
ENVELOPES = ("system-reminder", "task-notification", "command-name", "command-message", "command-args", "local-command-stdout", "local-command-stderr")

# Neighbours of each key on a QWERTY keyboard.
NEIGHBOURS = {
    "a": "qwsz", "b": "vghn", "c": "xdfv", "d": "serfcx", "e": "wsdr", "f": "drtgvc", "g": "ftyhbv", "h": "gyujnb", "i": "ujko", "j": "huikmn", "k": "jiolm",
    "l": "kop", "m": "njk", "n": "bhjm", "o": "iklp", "p": "ol", "q": "wa", "r": "edft", "s": "awedxz", "t": "rfgy", "u": "yhji", "v": "cfgb", "w": "qase",
    "x": "zsdc", "y": "tghu", "z": "asx",
}

# Provenance in rising order, with the prior that a word of it is a real one.
PROVENANCE = (("observed", 0.30), ("dependency", 0.70), ("installed", 0.80), ("tap", 0.90), ("owned", 0.95), ("user", 1.00))
RANK = {name: i for i, (name, _) in enumerate(PROVENANCE)}

# Thresholds and weights of the checker.
MIN_SOURCES, SHADOW_SOURCES, MIN_CORPUS_EVIDENCE = 2, 3, 2
SHADOW_LEVEL, JOIN_LEVEL = 35, 50
LEXICON_FLOOR = 3
MAX_EDIT_DISTANCE, MAX_SUGGESTIONS = 2, 3
EDIT_PENALTY, SUBSEQUENCE_BONUS, MIN_SUGGESTION_SCORE = 0.05, 25.0, 0.02
SPLIT_SHARE, JOIN_CONFIDENCE, CONTRACTION_CONFIDENCE = 0.35, 0.75, 0.90
MIN_NAME_LENGTH, NAME_CORROBORATION = 4, 2
MIN_REALWORD_EVIDENCE, REALWORD_RATIO = 3, 4.0


def confusables(spark: SparkSession) -> DataFrame:
    """``word, alternative, place``: every ordered pair within a set; ``place`` is the alternative's position in it."""
    rows = [(w, a, i) for s in CONFUSION_SETS for w in s for i, a in enumerate(s) if a != w]
    return spark.createDataFrame(rows, "word string, alternative string, place int")


def contractions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CONTRACTIONS), "word string, fixed string")


def sql_values(rows) -> str:
    """Rows as the body of a SQL ``VALUES`` list."""
    cell = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)
