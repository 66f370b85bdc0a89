"""Span-level de-identification and text-corpus operators on Spark."""
