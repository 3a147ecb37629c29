"""tidemark: time-series validation, risk analytics and record preparation on Spark DataFrames."""
