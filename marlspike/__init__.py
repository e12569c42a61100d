"""A tabular analytics engine on Spark DataFrames."""
