"""Training-data operators: decontamination, deduplication, tokenisation, scoring and filtering of text.

Nothing outside this subpackage imports it. Every operator takes DataFrames, keeps its own parameters, and
returns DataFrames; ``queries`` holds the thin queries with fixed result columns.
"""
