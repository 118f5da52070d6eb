"""A bitemporal multi-model analytics engine on Spark DataFrames."""
