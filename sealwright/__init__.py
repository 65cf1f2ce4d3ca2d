"""Sealwright: verifiable records and training-corpus processing as Spark DataFrame programs."""
