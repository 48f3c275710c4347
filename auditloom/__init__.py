"""auditloom: audit analytics over large collections of source files, on Spark.

Every operator takes DataFrames and returns DataFrames; see README.md.
"""

__version__ = "0.1.0"
