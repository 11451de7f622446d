"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from . import (
    decontaminate, lemp, minhash_join, mixing, pii, prefix_trie, quality_mil, quality_rules, repeats, secret_scan, token_counts,
    token_files, warc)

MODULES = [token_counts, quality_rules, secret_scan, decontaminate, warc, pii, repeats, minhash_join, quality_mil, mixing, token_files,
           prefix_trie, lemp]
QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
