"""All registered queries of the core library, with their SQL."""

from inkwell.plans import lexicon_queries, text_queries, upkeep_queries

QUERIES: dict = {**text_queries.QUERIES, **lexicon_queries.QUERIES, **upkeep_queries.QUERIES}
ORACLES: dict = {**text_queries.ORACLES, **lexicon_queries.ORACLES, **upkeep_queries.ORACLES}
