"""Operators of a training-data pipeline: deduplication, packing, token counts, scoring and output.

Each module holds one operator with its own general interface; ``queries`` binds the operators to
the whole tables of a data folder. Nothing outside this subpackage imports it.
"""
