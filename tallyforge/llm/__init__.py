"""Preparing text corpora for training: ten operators, one module each, and the queries that apply them."""
