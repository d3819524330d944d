"""All registered queries and their SQL."""

from workload import documents, metadata, store

MODULES = (documents, metadata, store)
QUERIES, ORACLES = {}, {}
for _m in MODULES:
    QUERIES.update(_m.QUERIES)
    ORACLES.update(_m.ORACLES)
