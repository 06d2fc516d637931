"""Typed-document analytics on Spark: Markdown corpora as relations, queries, validation and rewriting."""
