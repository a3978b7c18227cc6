"""nearfield: vector search and declarative-recall analytics on Spark DataFrames."""
