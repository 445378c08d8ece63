"""factgate: reliability-gated fact-graph analytics and data preparation on Spark DataFrames."""
