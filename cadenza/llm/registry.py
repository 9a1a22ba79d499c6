"""The queries of this subpackage and the SQL for those that SQL can express."""

from . import bpe, chat, decontaminate, licenses, merkle, packing, quality, sharding, simhash, spelling, substrings, urls, warc

MODULES = (simhash, substrings, urls, decontaminate, bpe, chat, warc, quality, sharding, licenses, merkle, spelling, packing)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in getattr(module, "ORACLE_SQL", {}).items()}
