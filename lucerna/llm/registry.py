"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from lucerna.llm import decontaminate, exact_dedup, html_text, minhash, mixing, ngram, pii, substring_dedup, toxicity, warc

MODULES = (mixing, toxicity, warc, exact_dedup, minhash, ngram, substring_dedup, html_text, decontaminate, pii)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
