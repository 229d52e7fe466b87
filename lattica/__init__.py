"""Policy and dependency analytics over fact tables, on Spark DataFrames."""
