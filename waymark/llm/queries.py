"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from waymark.llm import byte_bpe, decontaminate, host_quality, language_id, license_scan, masked_lm, periodic_runs, pii_crf, simhash, suffix_dedup, token_files, url_filter, vector_clusters

MODULES = (byte_bpe, decontaminate, host_quality, language_id, license_scan, masked_lm, periodic_runs, pii_crf, simhash, suffix_dedup, token_files, url_filter, vector_clusters)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
