"""fieldbook: curated-catalog analytics on Spark DataFrames."""
