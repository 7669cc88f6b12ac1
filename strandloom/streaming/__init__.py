"""Structured Streaming: the data model's natural streams are shards, panels and loci."""
