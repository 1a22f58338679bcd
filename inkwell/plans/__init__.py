"""Registered queries of the library."""

from . import answers, asked, choices, contexts, draws, judges, lattices, made, meanings, pairs, rules, sequences, stores, structures, tags, texts
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "answers", "asked", "choices", "contexts", "draws", "judges", "lattices", "made", "meanings", "pairs", "rules", "sequences", "stores", "structures", "tags", "texts"]
