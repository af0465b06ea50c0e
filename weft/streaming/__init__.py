"""Streaming forms of incremental operators."""
