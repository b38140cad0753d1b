"""A query builder and function library whose queries compile straight to Spark DataFrames."""
