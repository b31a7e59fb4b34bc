"""Corpus analytics, hybrid retrieval and retrieval evaluation on Spark DataFrames."""
