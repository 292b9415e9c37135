"""Evidence-corpus analytics on Spark DataFrames."""
