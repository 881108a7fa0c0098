"""graphtide: a knowledge-graph and simulation engine on Spark DataFrames."""
