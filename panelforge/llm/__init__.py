"""Training-data operators: deduplication, filtering, scoring, search and packing.

Nothing else in the library imports this subpackage. Every operator takes and returns
DataFrames; the contract queries registered in ``__spark_entry__`` are thin wrappers that live
in :mod:`panelforge.llm.queries`.
"""
