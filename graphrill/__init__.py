"""Graph analytics on Spark DataFrames: a typed, weighted, timestamped multigraph and the operators over it."""
