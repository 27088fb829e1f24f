"""A fluent data-processing library on Spark DataFrames."""
