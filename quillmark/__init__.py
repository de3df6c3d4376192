"""Stylometric analytics over code corpora, expressed as Spark DataFrame jobs."""
