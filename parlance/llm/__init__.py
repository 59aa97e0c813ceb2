"""Training-data operators: quality, privacy, decontamination, deduplication, tokens, scoring.

Nothing outside this package imports it.  Each module holds one operator with its own general
interface; :mod:`parlance.llm.queries` derives the registered ``opN_`` results from them.
"""
