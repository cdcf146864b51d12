"""Document sync and bulk search over a corpus of notices, as Spark DataFrames.

Layout: ``functions`` maps columns to columns, ``operators`` maps DataFrames to
DataFrames, ``sources`` reads and writes tables, ``streaming`` holds the
incremental jobs and ``plans`` chains operators into whole jobs.
"""
