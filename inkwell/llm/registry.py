"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("audio", "bpe", "language", "minhash", "mixing", "quality", "sharding", "simhash", "tokenstore", "warc")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(import_module(f"{__package__}.{name}"), attribute))
    return out


def queries() -> dict:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run, **_merged("QUERIES")}


def oracles() -> dict:
    return _merged("ORACLES")

