"""Operators of a training-data pipeline: ten methods, their queries and the SQL that checks them."""
