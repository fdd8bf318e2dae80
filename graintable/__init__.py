"""Spark jobs for document retrieval and price analysis."""
