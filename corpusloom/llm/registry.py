"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from corpusloom.llm import (
    html_extract,
    line_dedup,
    mixing,
    ngram_join,
    quality_rules,
    secret_scan,
    sentencepiece_codec,
    sharding,
    topk_search,
    warc,
)

_MODULES = (html_extract, secret_scan, mixing, quality_rules, warc, sentencepiece_codec, topk_search, sharding, ngram_join, line_dedup)

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
