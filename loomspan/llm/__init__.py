"""Operators for large text corpora and training sets."""

#: Modules with QUERIES and ORACLES.
QUERY_MODULES = ["loomspan.llm.queries"]
