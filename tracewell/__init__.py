"""tracewell: provenance analytics over host audit logs as Spark jobs.

Every function takes and returns DataFrames.  ``sources`` reads and writes,
``functions`` are column expressions, ``operators`` are the relational
building blocks, ``plans`` are whole workloads and ``streaming`` holds the
Structured Streaming entry points.
"""
