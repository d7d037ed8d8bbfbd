"""The registry of queries: name -> (spark, sf_dir) -> DataFrame, and the SQL twins that compute the same from the raw tables."""

from __future__ import annotations

from quirespark.plans import elements, layouts, markdown, outputs, pages, qa, scalars, stored

MODULES = (pages, markdown, scalars, elements, layouts, outputs, stored, qa)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
