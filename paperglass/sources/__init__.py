"""Scans with fixed schemas, normalisers of nested inputs, and partitioned sinks."""
