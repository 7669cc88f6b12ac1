"""strandloom: a PySpark-native engine for comparative-sequence and record-linkage workloads."""

__version__ = "0.1.0"
