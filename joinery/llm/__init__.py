"""Training-data operators: extraction, deduplication, filtering, tokenisation and archives.

Nothing outside this folder imports it.  Every operator takes DataFrames and
returns a DataFrame; ``queries.py`` derives the registered queries from them.
"""
