"""Spark-first analytics over multi-turn conversation tests."""
