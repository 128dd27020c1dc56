"""Inkwell: lexicon and text analytics on Spark."""
