"""medloom: set-at-a-time medication-data analytics on Spark DataFrames."""
