"""leafstack: set-at-a-time analytics over business documents, on Spark.

Every operator is a function from DataFrames to a DataFrame.  Nothing here keeps
session globals or collects data to the driver; Catalyst plans all of it.
"""
