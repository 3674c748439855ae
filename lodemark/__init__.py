"""Dataset audit, leakage detection and vector retrieval as DataFrame functions on Spark."""
