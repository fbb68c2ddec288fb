"""Spark-first triage engine for picture sequences, with text and vector operators."""
