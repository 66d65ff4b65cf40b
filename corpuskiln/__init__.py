"""Retrieval, event and relay operators as Spark DataFrame jobs."""
