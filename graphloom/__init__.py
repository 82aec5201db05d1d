"""graphloom: network analytics on Spark DataFrames."""
