"""deltagraph: incremental, accumulative graph analytics on Spark DataFrames."""
