"""All queries of this package, and the SQL for those that SQL can express."""

from . import bpe, mixing, near_dup, pii, quality_gam, quality_rules, secrets, topk, url_filter, warc

_MODULES = (mixing, bpe, near_dup, quality_rules, quality_gam, url_filter, secrets, warc, pii, topk)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
