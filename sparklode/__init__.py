"""String-constant mining and text analytics on Spark DataFrames."""
