"""Collects the registered queries of the text operators with their SQL."""

from __future__ import annotations

from importlib import import_module

from tripscope.plans.registry import Book

MODULES = [
    "exact_dedup", "near_dup", "suffix_dedup", "packing", "toxicity", "quality_rules", "sharding", "licenses", "rans", "sentencepiece_viterbi", "lexical_search",
    "filter_audit", "url_filter",
]


def load() -> Book:
    merged = Book()
    for module in MODULES:
        book = import_module(f"tripscope.llm.{module}").BOOK
        for name, fn in book.queries.items():
            merged.add(name, fn, book.sql.get(name))
    return merged
