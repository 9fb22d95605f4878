"""Operators for preparing training data, each a Spark job over whole tables."""
