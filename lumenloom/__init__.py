"""Spark-first analytics over schedules, feeds and text corpora."""
