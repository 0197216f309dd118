"""Spark-first operators for corpus curation and attempt-based evaluation."""
