"""leafloom: document analytics on Spark DataFrames."""
