"""clearframe: authority analytics over call graphs as Spark DataFrames."""
