"""Operators of a training-data pipeline. Nothing outside this subpackage imports it but the entry module and the corpus
pipeline, each of which works, or is left out, without it."""
