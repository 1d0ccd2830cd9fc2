"""framepack: profiling, validating, compressing and exchanging tabular data on PySpark."""
