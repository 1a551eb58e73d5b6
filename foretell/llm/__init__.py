"""Training-data operators: tokenising, pseudonymising, archiving, chat formatting, deduplication, search, mixing, rules.

Nothing outside this folder imports it. The registered queries are in :mod:`foretell.llm.queries`.
"""
