"""Sequence, process-tree and log analytics expressed as plain Spark plans."""
