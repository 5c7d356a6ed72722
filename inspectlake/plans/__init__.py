"""The registered queries and the SQL each is checked against."""

from inspectlake.plans import (
    caching,
    inputs,
    lifecycle,
    merging,
    pages,
    responses,
    reviews,
    storage,
    streams,
    trees,
)

_MODULES = [inputs, responses, merging, trees, caching, reviews, pages, storage, streams, lifecycle]

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: text for m in _MODULES for name, text in m.ORACLES.items()}
