"""Operators for preparing large text corpora, all as Spark jobs."""
