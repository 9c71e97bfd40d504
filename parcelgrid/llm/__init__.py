"""Operators for large text corpora, their queries and the SQL that checks them."""
