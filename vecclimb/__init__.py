"""Embedding-guided search over very large item libraries, written for Spark."""
