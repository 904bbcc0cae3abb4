"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, infill, minhash, neighbours, packing, pii, repeats, secrets, sharding, toxicity, urlfilter, whitening

MODULES = (decontaminate, toxicity, urlfilter, sharding, minhash, chat, packing, neighbours, secrets, pii, infill, whitening, repeats)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
