"""Readers and writers of sequence, alignment, interval and annotation formats, by Spark's own text and JSON readers."""
