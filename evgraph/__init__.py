"""evgraph: evidence-backed property graphs on Spark DataFrames."""
