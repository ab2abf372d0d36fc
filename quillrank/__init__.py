"""Ranking and retrieval of text documents as Spark plans."""
