"""hireframe: recruitment analytics on Spark DataFrames."""
