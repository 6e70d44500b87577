"""Operators of a training-data pipeline.  Nothing else in the library imports this package."""

from importlib import import_module

from airlake.llm.registry import ORACLES, QUERIES

MODULES = ("token_orc", "pii", "mixing", "sentencepieces", "secrets", "ngram_jaccard", "topk_nra", "syncmers", "language_id", "chat_format", "whitening", "toxicity", "importance")

for _name in MODULES:
    import_module(f"airlake.llm.{_name}")

__all__ = ["ORACLES", "QUERIES"]
